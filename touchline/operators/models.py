"""Regression, classification and ranking models fitted from one-pass sums."""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.scalars import clamp
from touchline.operators.joins import may_meet
from touchline.operators.ordered import positions as number_rows
from touchline.operators.ordered import running_totals
from touchline.session import durable


def ridge(df: DataFrame, group: str, features: list[str], target: str, alpha: float = 1.0, min_rows: int = 20, label: str = "ALL") -> DataFrame:
    """Ridge on standardised features for ALL rows and for each group.

    One pass collects the cross-product sums of every group (grouping sets, combined map
    side); each small k x k system is then solved from its single row of sums.
    Returns group, feature, n, coef_std, coef_raw, intercept, r2.
    """
    cols = [*features, target]
    k = len(features)
    # shift by a rough overall mean first, so the sums of squares keep their digits
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("m")).scalar()
    with_means = df.select(F.col(group), *cols).withColumn("_m", means)
    shifted = with_means.select(F.col(group), "_m", *[(F.col(c).cast("double") - F.col(f"_m.{c}")).alias(c) for c in cols])
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    cross = [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"x_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    agg = shifted.rollup(group).agg(
        F.grouping(group).alias("_all"), F.count("*").alias("n"), F.first("_m").alias("_m"), *sums, *cross
    ).where(F.col("n") >= min_rows)
    agg = agg.withColumn(group, F.when(F.col("_all") == 1, F.lit(label)).otherwise(F.col(group).cast("string")))
    agg = agg.withColumns({f"m_{i}": F.col(f"_m.{c}") for i, c in enumerate(cols)}).drop("_m", "_all")

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n = row["n"]
                s = np.array([row[f"s_{i}"] for i in range(k + 1)])
                x = np.zeros((k + 1, k + 1))
                for i in range(k + 1):
                    for j in range(i, k + 1):
                        x[i, j] = x[j, i] = row[f"x_{i}_{j}"]
                cov = x - np.outer(s, s) / n
                scale = np.sqrt(np.maximum(np.diag(cov)[:k] / n, 0))
                scale[scale == 0] = 1.0
                gram = cov[:k, :k] / np.outer(scale, scale)
                beta = np.linalg.solve(gram + alpha * np.eye(k), cov[:k, k] / scale)
                mean = s / n + np.array([row[f"m_{i}"] for i in range(k + 1)])
                raw = beta / scale
                sse = cov[k, k] - 2 * beta @ (cov[:k, k] / scale) + beta @ gram @ beta
                r2 = 1 - sse / cov[k, k] if cov[k, k] > 0 else 0.0
                for i, f in enumerate(features):
                    out.append((row[group], f, n, beta[i], raw[i], mean[k] - raw @ mean[:k], r2))
            yield pd.DataFrame(out, columns=[group, "feature", "n", "coef_std", "coef_raw", "intercept", "r2"])

    schema = f"`{group}` string, feature string, n long, coef_std double, coef_raw double, intercept double, r2 double"
    return agg.mapInPandas(solve, schema)


def coefficient_table(model: DataFrame, group: str, features: list[str]) -> DataFrame:
    """One row per group: intercept and one column per feature."""
    return model.groupBy(group).agg(
        F.first("intercept").alias("intercept"),
        *[F.max(F.when(F.col("feature") == f, F.col("coef_raw"))).alias(f"b_{f}") for f in features],
    )


def rescore(rows: DataFrame, corrections: DataFrame, model: DataFrame, group: str, features: list[str],
            stat: str, keys: list[str], low: float = 1.0, high: float = 10.0, label: str = "ALL") -> DataFrame:
    """Counterfactual prediction after adding ``delta`` to one statistic.

    Uses the row's group model, else the ALL model; unmatched corrections keep null predictions.
    """
    coefs = coefficient_table(model, group, features)
    own = coefs.select(F.col(group), F.struct("intercept", *[f"b_{f}" for f in features]).alias("_own"))
    every = coefs.where(F.col(group) == label).select(F.struct("intercept", *[f"b_{f}" for f in features])).scalar()
    # corrections are few against the rows, most of which no shuffle needs to see
    hit = corrections.join(may_meet(rows, corrections, keys), keys, "left").join(own, group, "left").withColumn("_c", F.coalesce("_own", every))

    def predict(extra: Column) -> Column:
        total = F.col("_c.intercept")
        for f in features:
            x = F.coalesce(F.col(f).cast("double"), F.lit(0.0))
            total = total + F.col(f"_c.b_{f}") * (x + extra if f == stat else x)
        return clamp(total, low, high)

    found = F.col(features[0]).isNotNull()
    out = hit.withColumn("predicted", F.when(found, predict(F.lit(0.0)))).withColumn(
        "corrected", F.when(found, predict(F.col("delta").cast("double")))
    )
    return out.withColumn("change", F.col("corrected") - F.col("predicted")).drop("_own", "_c")


def logistic(df: DataFrame, features: list[str], target: str, max_iter: int = 100):
    """L2 logistic regression (C = 1, free intercept) on population-standardised features.

    Returns (coefficient table, scored rows).
    """
    names = [*features]
    stats = df.agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in names], *[F.stddev_pop(f).alias(f"s_{f}") for f in names]
    ).first()
    scaled = df
    for f in names:
        spread = stats[f"s_{f}"] or 1.0
        scaled = scaled.withColumn(f"_z_{f}", (F.col(f) - F.lit(float(stats[f"m_{f}"]))) / F.lit(float(spread)))
    vector = VectorAssembler(inputCols=[f"_z_{f}" for f in names], outputCol="_x").transform(scaled)
    fit = LogisticRegression(
        featuresCol="_x", labelCol=target, regParam=1.0 / stats["n"], elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=1e-10, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y",
    ).fit(vector)
    scored = fit.transform(vector).withColumn("score", vector_to_array("_p")[1])
    scored = scored.drop("_x", "_p", "_r", "_y", *[f"_z_{f}" for f in names])
    spark = df.sparkSession
    rows = [(f, float(c)) for f, c in zip(names, fit.coefficients)] + [("intercept", float(fit.intercept))]
    return spark.createDataFrame(rows, "feature string, coefficient double"), scored


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum with averaged ties.

    Rows are folded to one per distinct score first; the ordered sums run over slices.
    """
    by_score = _score_counts(scored, score, label)
    run = running_totals(by_score, [], [F.col(score)], {"_neg_below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("_neg_below") - F.col("neg") + F.col("neg") / 2))
    out = run.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("_w"))
    return out.select("n_pos", "n_neg", (F.col("_w") / F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auc"))


def roc_curve(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One point per distinct score used as threshold, from high to low."""
    by_score = _score_counts(scored, score, label)
    run = running_totals(by_score, [], [F.col(score).desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    pos, neg = by_score.agg(F.sum("pos")).scalar(), by_score.agg(F.sum("neg")).scalar()
    return run.select(F.col(score), (F.col("tp") / pos).alias("tpr"), (F.col("fp") / neg).alias("fpr"))


def _score_counts(scored: DataFrame, score: str, label: str) -> DataFrame:
    return scored.groupBy(score).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg")
    )


def simple_ols(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Slope, intercept and R² per group."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("n"), F.regr_slope(yc, xc).alias("slope"), F.regr_intercept(yc, xc).alias("intercept"), F.regr_r2(yc, xc).alias("r2")
    )


def with_residual(df: DataFrame, x: str, y: str, name: str = "residual") -> DataFrame:
    """Distance of each row from the overall line."""
    line = simple_ols(df, x, y)
    fit = line.select(F.struct("slope", "intercept")).scalar()
    fitted = F.col("_fit.intercept") + F.col("_fit.slope") * F.col(x)
    return df.withColumn("_fit", fit).withColumn(name, F.col(y) - fitted).drop("_fit")


def buyable(candidates: DataFrame, most: dict[str, int]) -> DataFrame:
    """Candidates that a greedy buy by points can ever reach.

    Behind ``most[position]`` rows of its position that score as much and cost no more, a row is never bought: one of
    them was skipped for want of money while a place was free, and money only falls. Each partition drops such rows
    first; what is left is not brought together for it.
    """

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch])
            rows = rows.sort_values(["xpts", "id"], ascending=[False, True], ignore_index=True)
            cheapest: dict[str, list[float]] = {p: [] for p in most}  # negated prices of the cheapest rows so far
            keep = []
            for position, price in zip(rows["position"], rows["price"]):
                heap, n = cheapest.get(position, []), most.get(position, 0)
                keep.append(len(heap) < n or n > 0 and price < -heap[0])
                if len(heap) < n:
                    heapq.heappush(heap, -price)
                elif n and price < -heap[0]:
                    heapq.heapreplace(heap, -price)
            kept = rows[keep]
        if kept is not None:
            yield kept

    good = candidates.where((F.col("xpts") > 0) & (F.col("price") > 0)).select("id", "position", "price", "xpts")
    return good.mapInPandas(prune, good.schema)


def menus(candidates: DataFrame, positions: list[str], size: int) -> DataFrame:
    """Candidates in order of points, cut into slices of ``size``: slice, menu, and per position the least price after it.

    Rows are numbered over range partitions (``positions`` of the ordered operators); one row a slice meets in a window.
    """
    ranked = number_rows(candidates, [], [F.col("xpts").desc(), F.col("id")], "_at")
    item = F.struct("_at", "id", "position", "price", "xpts")
    least = [F.min(F.when(F.col("position") == p, F.col("price"))).alias(f"_min_{p}") for p in positions]
    slices = ranked.groupBy(F.floor((F.col("_at") - 1) / size).alias("slice")).agg(F.sort_array(F.collect_list(item)).alias("menu"), *least)
    after = Window.orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return slices.select("slice", "menu", *[F.min(f"_min_{p}").over(after).alias(f"later_{p}") for p in positions])


#: Candidates that a plan walks through before it is asked whether its places are filled.
PART = 32


def best_plan(plans: DataFrame, plan_keys: list[str], group: list[str], candidates: DataFrame, positions: list[str], slice_size: int = 1024) -> DataFrame:
    """Evaluate every plan with a greedy buy by points and keep the best per ``group``; a group without a plan that
    can be filled keeps its row with null results. Returns group, the other plan keys, total, money_left and ``chosen``,
    the bought rows (position, id, xpts) in the order they were bought.

    ``plans``: plan keys, budget, keep_points, one ``need_<position>`` per position and, if wanted, ``owned``, an array
    of ids that must not be bought. ``candidates``: id, position, price, xpts. Their list is swept slice by slice: each
    plan carries its money, places and purchases from one slice to the next, and stops as soon as its places are filled
    or no later candidate of an open place is cheap enough. A slice is all a task, or the driver, holds of the list, and
    the rest of it is left out once a plan's places are filled.
    """
    owns = "owned" in plans.columns
    limits = plans.agg(*[F.max(f"need_{p}").alias(p) for p in positions], F.max(F.size("owned") if owns else F.lit(0)).alias("owned")).first()
    reach = buyable(candidates, {p: (limits[p] or 0) + (limits["owned"] or 0) for p in positions})
    menu = F.transform(F.sequence(F.lit(0), F.floor((F.size("menu") - 1) / PART).cast("int")), lambda i: F.slice("menu", i * PART + 1, F.lit(PART)))
    slices = durable(menus(reach, positions, slice_size).withColumn("menu", menu))
    last = slices.agg(F.max("slice")).first()[0]
    id_type = candidates.schema["id"].dataType.simpleString()
    bought_type = f"array<struct<position:string,id:{id_type},xpts:double>>"
    needs = [f"need_{p}" for p in positions]
    start = {"_money": F.col("budget").cast("double"), "_points": F.lit(0.0), "_chosen": F.array().cast(bought_type), **{n: F.col(n).cast("int") for n in needs}}
    active = plans.select("*", F.lit(0).cast("long").alias("slice")).withColumns(start)
    wanted = sum((F.col(n) for n in needs[1:]), F.col(needs[0]))
    free = (lambda c: ~F.coalesce(F.array_contains("owned", c["id"]), F.lit(False))) if owns else (lambda c: F.lit(True))
    state = F.struct(F.col("_money").alias("money"), F.col("_points").alias("points"), F.col("_chosen").alias("chosen"), *needs)

    def step(s, c):
        left = F.lit(0)
        for p in positions:
            left = F.when(c["position"] == p, s[f"need_{p}"]).otherwise(left)
        row = F.array(F.struct(c["position"].alias("position"), c["id"].alias("id"), c["xpts"].cast("double").alias("xpts")))
        bought = F.struct(
            (s["money"] - c["price"]).alias("money"), (s["points"] + c["xpts"]).alias("points"), F.concat(s["chosen"], row).cast(bought_type).alias("chosen"),
            *[(s[f"need_{p}"] - (c["position"] == p).cast("int")).alias(f"need_{p}") for p in positions],
        )
        return F.when((c["price"] <= s["money"]) & (left > 0) & free(c), bought).otherwise(s)

    filled = lambda s: sum((s[n] for n in needs[1:]), s[needs[0]]) == 0
    part = lambda s, some: F.when(filled(s), s).otherwise(F.aggregate(some, s, step))
    cores = plans.sparkSession.sparkContext.defaultParallelism
    active, done, at = durable(active.repartition(cores, *plan_keys)), [], 0
    while last is not None and at <= last:
        walked = active.join(F.broadcast(slices.where(F.col("slice") == at)), "slice").withColumn("_s", F.aggregate("menu", state, part)).drop("menu", "_money", "_points", "_chosen", *needs)
        walked = walked.select("*", F.col("_s.money").alias("_money"), F.col("_s.points").alias("_points"), F.col("_s.chosen").alias("_chosen"), *[F.col(f"_s.{n}").alias(n) for n in needs]).drop("_s")
        open_place = F.lit(False)
        for p in positions:
            open_place = open_place | F.coalesce((F.col(f"need_{p}") > 0) & (F.col(f"later_{p}") <= F.col("_money")), F.lit(False))
        walked = durable(walked.withColumn("_open", open_place).drop(*[f"later_{p}" for p in positions]))
        done.append(walked.where(~F.col("_open")).drop("_open", "slice"))
        active = walked.where("_open").drop("_open").withColumn("slice", F.col("slice") + 1)
        at += 1
        if at <= last and active.isEmpty():
            break
    done.append(active.drop("slice"))
    ended = done[0]
    for part in done[1:]:
        ended = ended.unionByName(part)
    # incomplete plans get a null total, which max_by skips
    ended = ended.withColumn("total", F.when(wanted == 0, F.col("keep_points") + F.col("_points")))
    order = F.when(F.col("total").isNotNull(), F.struct("total", *[-F.col(k) for k in plan_keys]))
    pick = F.max_by(F.struct(*plan_keys, "total", F.col("_money").alias("money_left"), F.col("_chosen").alias("chosen")), order)
    rest = [k for k in plan_keys if k not in group]
    best = ended.groupBy(*group).agg(pick.alias("_b"))
    return best.select(*group, *[F.col(f"_b.{k}") for k in rest], "_b.total", "_b.money_left", "_b.chosen")
