"""Propensity scores, matching on their logits, balance and validation."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit
from ..sources.store import stage_table
from .causal import OBSERVATIONAL, VALIDATED

#: Of a matched pair's logits, in deviations of all logits.
CALIPER = 0.2
#: What a validated effect must meet: balance of every covariate, range of scores, replicates of the bootstrap.
MOST_SMD, LOW, HIGH, REPLICATES = 0.1, 0.1, 0.9, 5
PENALTY, ROUNDS, SETTLED = 1.0, 50, 1e-10


@dataclass
class Model:
    """A logistic regression over standardised covariates: a weight each, then the intercept."""

    covariates: tuple[str, ...]
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def values(self) -> list[Column]:
        return [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - float(m)) / float(s) for c, m, s in zip(self.covariates, self.mean, self.deviation, strict=True)]

    def logit(self) -> Column:
        out = F.lit(float(self.weights[-1]))
        for w, v in zip(self.weights, self.values(), strict=False):
            out = out + float(w) * v
        return out


def fit(rows: DataFrame, covariates: tuple[str, ...], treated: str = "treated", penalty: float = PENALTY) -> Model:
    """Both sides weigh the same in all, and the weights (not the intercept) are penalised by half their square.

    Iteratively reweighted least squares: a round is one aggregation, of the sums of products that its normal equations
    are made of, whatever the number of rows. Null covariates are 0; those without spread get no weight.
    """
    d = len(covariates)
    value = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in covariates]
    first = rows.agg(F.count("*"), F.sum(F.col(treated).cast("double")), *[F.avg(v) for v in value], *[F.stddev_pop(v) for v in value]).first()
    n, ones = first[0], first[1] or 0.0
    if not 0 < ones < n:
        raise ValueError("both sides must have rows")
    spread = np.array(first[2 + d :], float)
    model = Model(tuple(covariates), np.array(first[2 : 2 + d], float), np.where(spread < 1e-12, 1.0, spread), np.zeros(d + 1))
    balance = F.when(F.col(treated), n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    ridge = penalty * np.diag([1.0] * d + [0.0])
    held = rows.select(F.col(treated).cast("double").alias("_y"), balance.alias("_b"), *[v.alias(f"_v{i}") for i, v in enumerate(model.values())], F.lit(1.0).alias(f"_v{d}"))
    for _ in range(ROUNDS):
        z = sum((float(w) * F.col(f"_v{i}") for i, w in enumerate(model.weights)), F.lit(0.0))
        p = F.lit(1.0) / (1 + F.exp(-z))
        at = held.withColumn("_p", p).withColumn("_w", F.col("_b") * F.col("_p") * (1 - F.col("_p")))
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        sums = at.agg(*[F.sum(F.col("_w") * F.col(f"_v{i}") * F.col(f"_v{j}")) for i, j in pairs], *[F.sum(F.col("_b") * (F.col("_y") - F.col("_p")) * F.col(f"_v{i}")) for i in range(d + 1)]).first()
        normal = np.zeros((d + 1, d + 1))
        for (i, j), x in zip(pairs, sums, strict=False):
            normal[i, j] = normal[j, i] = x
        step = np.linalg.solve(normal + ridge, np.array(sums[len(pairs) :]) - ridge @ model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < SETTLED:
            return model
    raise RuntimeError("the scores did not settle")


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with logit and propensity."""
    return rows.withColumn("logit", model.logit()).withColumn("propensity", 1 / (1 + F.exp(-F.col("logit"))))


def nearest(rows: DataFrame) -> DataFrame:
    """(seq, control, distance): the nearest control by logit of each treatment, the earliest of equals, of rows (seq, treated, logit).

    Controls of one logit are told by their earliest. Rows are dealt by ranges of logits and swept in each; what a range
    lacks at its ends is the nearest control of the ranges before and after, of which each leaves its first and last.
    """
    known = rows.filter("logit IS NOT NULL AND NOT isnan(logit)")
    controls = known.filter("NOT treated").groupBy("logit").agg(F.min("seq").alias("control")).select("logit", F.lit(None).cast("long").alias("seq"), F.col("control").cast("long"))
    both = controls.unionByName(known.filter("treated").select("logit", F.col("seq").cast("long"), F.lit(None).cast("long").alias("control")))
    # the task is written down, as a second run might cut the ranges otherwise
    dealt = stage_table(both.repartitionByRange("logit").withColumn("task", F.spark_partition_id()), "logits")
    here = F.when(F.col("control").isNotNull(), F.struct("logit", "control"))
    # a control stands before the treatments of its logit; what comes after is swept backwards, as a window that ends with
    # its task is summed anew for every row
    up = Window.partitionBy("task").orderBy("logit", F.asc_nulls_last("control")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("task").orderBy(F.desc("logit"), F.asc_nulls_last("control")).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("task").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    earlier, later = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("task"), F.desc("task")))  # a row a task
    carried = ends.select("task", F.last("last", True).over(earlier).alias("before"), F.last("first", True).over(later).alias("after"))
    swept = dealt.select("task", "logit", "seq", F.last(here, True).over(up).alias("left"), F.last(here, True).over(down).alias("right"))
    swept = swept.filter("seq IS NOT NULL").join(carried, "task")
    sides = F.array(F.coalesce("left", "before"), F.coalesce("right", "after"))
    near = F.array_min(F.transform(F.filter(sides, lambda s: s.isNotNull()), lambda s: F.struct(F.abs(F.col("logit") - s["logit"]).alias("distance"), s["control"].alias("control"))))
    return swept.select("seq", near.alias("near")).filter("near IS NOT NULL").select("seq", "near.control", "near.distance")


def matched(rows: DataFrame, caliper: float = CALIPER) -> DataFrame:
    """(seq, control): pairs of scored rows (seq, treated, logit). A treatment has its nearest control alone, within ``caliper`` deviations of all logits; of several that have the same one the earliest keeps it."""
    spread = rows.agg((F.lit(caliper) * F.stddev_pop("logit")).alias("_most"))  # one row
    near = nearest(rows).crossJoin(F.broadcast(spread)).filter("distance <= _most")
    return near.groupBy("control").agg(F.min("seq").alias("seq")).select("seq", "control")


def smds(pairs: DataFrame, covariates: tuple[str, ...]) -> DataFrame:
    """(covariate, smd) over pairs with t_ and c_ columns of each covariate: the absolute difference of the means over the root of the mean variance, 0 without any."""
    aggs = []
    for c in covariates:
        t, k = F.col(f"t_{c}"), F.col(f"c_{c}")
        pooled = F.sqrt((F.var_pop(t) + F.var_pop(k)) / 2)
        gap = F.abs(F.avg(t) - F.avg(k))
        aggs.append(F.when(pooled > 0, gap / pooled).when(gap > 0, F.lit(float("inf"))).otherwise(0.0).alias(c))
    one = pairs.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).alias("smd")) for c in covariates])).alias("x")).select("x.*")


def poisson(u: Column, most: int = 12) -> Column:
    """A Poisson number of mean 1 from a uniform one."""
    below, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        below.append((k, total))
    out = F.lit(most)
    for k, x in reversed(below):
        out = F.when(u < x, k).otherwise(out)
    return out


def replicates(pairs: DataFrame, key: str = "seq", effect: str = "effect", n: int = REPLICATES) -> DataFrame:
    """One row, b0, b1, ...: the mean effect in each bootstrap sample. A pair's times in a sample are drawn by its key, so that all are summed in one pass and any rerun agrees."""
    aggs = []
    for b in range(n):
        times = poisson(unit(F.col(key), seed=f"boot{b}"))
        aggs.append((F.sum(times * F.col(effect)) / F.nullif(F.sum(times), F.lit(0))).alias(f"b{b}"))
    return pairs.agg(*aggs)


def validated(rows: DataFrame, covariates: tuple[str, ...], caliper: float = CALIPER) -> DataFrame:
    """One row (n, ate, max_smd, low, high, stable, status) of rows (seq, treated, outcome, covariates): match on propensity and judge it.

    An effect is stable if every bootstrap sample gives it the same sign and no sample is off by more than half of it.
    """
    model = fit(rows, covariates)
    held = stage_table(scored(rows, model).select("seq", "treated", "logit", "propensity", F.coalesce(F.col("outcome").cast("double"), F.lit(0.0)).alias("outcome"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in covariates]), "scored")
    side = lambda s, key: held.select(F.col("seq").alias(key), F.col("outcome").alias(f"{s}_outcome"), F.col("propensity").alias(f"{s}_p"), *[F.col(c).alias(f"{s}_{c}") for c in covariates])
    pairs = matched(held, caliper).join(side("t", "seq"), "seq").join(side("c", "control"), "control").withColumn("effect", F.col("t_outcome") - F.col("c_outcome"))
    pairs = stage_table(pairs, "pairs")
    out = pairs.agg(F.count("*").alias("n"), F.avg("effect").alias("ate"), F.least(F.min("t_p"), F.min("c_p")).alias("low"), F.greatest(F.max("t_p"), F.max("c_p")).alias("high"))
    out = out.crossJoin(F.broadcast(smds(pairs, covariates).agg(F.max("smd").alias("max_smd")))).crossJoin(F.broadcast(replicates(pairs)))  # one row each
    boots = F.array(*[F.col(f"b{b}") for b in range(REPLICATES)])
    steady = F.coalesce(F.forall(boots, lambda b: (b * F.col("ate") > 0) & (F.abs(b - F.col("ate")) <= F.abs(F.col("ate")) / 2)), F.lit(False))
    sound = (F.col("n") >= VALIDATED) & (F.col("max_smd") < MOST_SMD) & (F.col("low") >= LOW) & (F.col("high") <= HIGH) & F.col("stable")
    status = F.when(sound, "counterfactual_validated").when(F.col("n") >= OBSERVATIONAL, "observational").otherwise("hypothesis")
    return out.withColumn("stable", steady).select("n", "ate", "max_smd", "low", "high", "stable", status.alias("status"))
