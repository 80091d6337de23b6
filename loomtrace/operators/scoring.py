"""Scores of generated facts against a source, and the statistics that compare systems."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomtrace.operators.ordered import mid_ranks
from loomtrace.operators.vectors import top_k

_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else _NORMAL.cdf(x))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda x: None if pd.isna(x) or not 0 < x < 1 else _NORMAL.inv_cdf(x))


def support(facts: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """(fact_id, source_id, score): the best source of each fact of facts(query_id, q); null without one."""
    best = top_k(facts.select("query_id", "q"), corpus, 1, 0.0, digits=digits)
    return facts.select("query_id").join(best, "query_id", "left").select(F.col("query_id").alias("fact_id"), F.col("doc_id").alias("source_id"), F.col("similarity").alias("score"))


def source_side(supported: DataFrame) -> DataFrame:
    """(source_id, score): the highest score that each source gives."""
    return supported.where("source_id is not null").groupBy("source_id").agg(F.max("score").alias("score"))


def adherence(scores: DataFrame, group: Sequence[str] = (), threshold: float = 0.7) -> DataFrame:
    """Of source-side scores: how many there are and reach the threshold, their share and their mean."""
    return scores.groupBy(*group).agg(
        F.count("score").alias("fact_count"),
        F.count_if(F.col("score") >= threshold).alias("supporting_facts"),
        (F.count_if(F.col("score") >= threshold) / F.count("score")).alias("fact_score"),
        F.avg("score").alias("fact_score_fuzzy"),
    )


def cliffs_delta(rows: DataFrame, value: str, side: Column, group: Sequence[str] = ()) -> DataFrame:
    """(group, delta) of the values where ``side`` holds against the others, from ranks instead of pairs.

    With mid-ranks R of one side of n against m others, U = R - n(n+1)/2 and delta = 2U/(nm) - 1.
    """
    ranked = mid_ranks(rows.withColumn("_x", side), value, group, "_r")
    out = ranked.groupBy(*group).agg(F.sum(F.when(F.col("_x"), F.col("_r"))).alias("r"), F.count_if("_x").alias("n"), F.count_if(~F.col("_x")).alias("m"))
    u = F.col("r") - F.col("n") * (F.col("n") + 1) / 2
    return out.select(*group, (2 * u / (F.col("n") * F.col("m")) - 1).alias("delta"))


def mann_whitney(rows: DataFrame, value: str, side: Column, group: Sequence[str] = ()) -> DataFrame:
    """(group, n1, n2, u, z): Mann-Whitney U of one side, and its normal deviate with ties corrected."""
    ranked = mid_ranks(rows.withColumn("_x", side), value, group, "_r")
    ties = ranked.groupBy(*group, value).agg(F.count("*").cast("double").alias("t")).groupBy(*group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    out = ranked.groupBy(*group).agg(F.sum(F.when(F.col("_x"), F.col("_r"))).alias("r"), F.count_if("_x").alias("n1"), F.count_if(~F.col("_x")).alias("n2"))
    out = out.join(ties, list(group)) if group else out.join(F.broadcast(ties))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return out.select(*group, "n1", "n2", u.alias("u"), ((u - n1 * n2 / 2) / F.nullif(sd, F.lit(0.0))).alias("z"))


def wilcoxon(rows: DataFrame, difference: Column, group: Sequence[str] = (), pratt: bool = False) -> DataFrame:
    """(group, n, w_plus, w_minus, z) of the signed-rank test; zero differences are dropped, or with pratt ranked and then dropped."""
    d = rows.withColumn("_d", difference).where("_d is not null")
    if not pratt:
        d = d.where("_d <> 0")
    ranked = mid_ranks(d.withColumn("_a", F.abs("_d")), "_a", group, "_r").where("_d <> 0")
    ties = ranked.groupBy(*group, "_a").agg(F.count("*").cast("double").alias("t")).groupBy(*group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    out = ranked.groupBy(*group).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("_d") < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("_r") * F.col("_r")).alias("squares")
    )
    # The ranks' squares hold the correction for ties and for ranks that zeros took.
    mean = (F.col("w_plus") + F.col("w_minus")) / 2
    out = out.join(ties, list(group)) if group else out.join(F.broadcast(ties))
    return out.select(*group, "n", "w_plus", "w_minus", ((F.col("w_plus") - mean) / (F.sqrt("squares") / 2)).alias("z"))


def upper_tail(z: Column) -> Column:
    """The chance of a normal deviate above z, to seven digits."""
    # The coefficients of a rational approximation.
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def strategy_pairs(ratings: DataFrame, strategies: Sequence[str], pratt: bool = True) -> DataFrame:
    """(metric, first, second, n, w_plus, w_minus, z, p): the signed-rank test of every two strategies over question means.

    p is that of the second being greater than the first.
    """
    means = question_means(ratings, strategies)
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i + 1 :]]
    each = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs))
    rows = means.select("metric", F.explode(each).alias("x")).select("metric", "x.first", "x.second", F.round("x.d", 9).alias("d"))
    done = wilcoxon(rows, F.col("d"), ["metric", "first", "second"], pratt)
    return done.withColumn("p", 1 - upper_tail(F.col("z")))


def two_sample_bootstrap(rows: DataFrame, value: str, side: Column, draws: int, function: Callable[[Column, Column], Column], steps: tuple[tuple[int, int], tuple[int, int]] | None = None, statistic=F.avg, order: str | None = None) -> DataFrame:
    """(draw, value): a function of a statistic of each side, both resampled on their own."""
    rows = rows.withColumn("_side", side)
    a, b = (
        bootstrap(rows.where(F.col("_side") == (k == 0)), value, draws, steps[k] if steps else None, seed=5 + k, statistic=statistic, order=order).withColumnRenamed("value", f"v{k}")
        for k in (0, 1)
    )
    return a.join(b, "draw").select("draw", function(F.col("v0"), F.col("v1")).alias("value"))


def compare_models(ratings: DataFrame, model: str, first: str, second: str) -> DataFrame:
    """(metric, strategy, n1, n2, u, z, p): Mann-Whitney of one model's scores against another's; p of the first being greater."""
    rows = ratings.where(F.col(model).isin(first, second)).select("metric", "strategy", model, "score")
    done = mann_whitney(rows, "score", F.col(model) == first, ["metric", "strategy"])
    return done.withColumn("p", upper_tail(F.col("z")))


def cohens_dz(z: Column, n: Column) -> Column:
    return z / F.sqrt(n)


def dz_interval(dz: Column, n: Column, z: float = 1.959964) -> Column:
    half = z * F.sqrt(1 / n + dz * dz / (2 * n))
    return F.struct((dz - half).alias("low"), (dz + half).alias("high"))


def rank_biserial(u: Column, n1: Column, n2: Column) -> Column:
    return 1 - 2 * u / (n1 * n2)


def r_of_u(u: Column, n1: Column, n2: Column) -> Column:
    return (u - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12) / F.sqrt(n1 + n2)


def d_of_r(r: Column) -> Column:
    return 2 * r / F.sqrt(1 - r * r)


def quartiles(rows: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*group).agg(q.alias("_q"), F.count(value).alias("n")).select(*group, *(F.get("_q", k).alias(n) for k, n in enumerate(("q1", "median", "q3"))), "n")


def bootstrap(rows: DataFrame, value: str, draws: int, step: tuple[int, int] | None = None, seed: int = 5, statistic=F.avg, order: str | None = None) -> DataFrame:
    """(draw, value): a statistic of each of ``draws`` resamples of as many rows as there are.

    A resample's i-th row is given by a hash of draw and place, or by (draw * p + i * q) modulo n
    with ``step`` = (p, q), so a rerun gives the same. Rows are numbered once and joined by number.
    """
    n = rows.count()
    w = Window.orderBy(order or value)
    numbered = rows.select((F.row_number().over(w) - 1).cast("long").alias("i"), F.col(value).alias("x"))
    spark = rows.sparkSession
    grid = spark.range(draws * n).select(F.floor(F.col("id") / n).alias("draw"), (F.col("id") % n).alias("k"))
    pick = F.pmod(F.col("draw") * step[0] + F.col("k") * step[1], F.lit(n)) if step else F.pmod(F.xxhash64("draw", "k", F.lit(seed)), F.lit(n))
    return grid.withColumn("i", pick).join(numbered, "i").groupBy("draw").agg(statistic("x").alias("value"))


def percentile_interval(draws: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return draws.agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and its p-value by Royston's approximation, for 4 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not 4 <= n <= 5000 or x[0] == x[-1]:
        raise ValueError("needs 4 to 5000 values that differ")
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(mm)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[-2], a[1] = second, -second
    else:
        a = m / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
    a[-1], a[0] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n <= 11:
        g = -2.273 + 0.459 * n
        y, mu, sd = -math.log(g - math.log(1 - w)), np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        k = math.log(n)
        y, mu, sd = math.log(1 - w), np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
    return w, 1 - _NORMAL.cdf((y - mu) / sd)


# The study's filters and means.


def all_ten(evaluations: Column) -> Column:
    """Whether (evaluation, metric) pairs whose scores are all 10 are as many as the evaluations."""
    tens = F.aggregate(evaluations, F.lit(0), lambda n, e: n + F.size(F.filter(F.map_values(e["evaluation_dict"]), lambda m: F.forall(F.map_values(m), lambda v: v == 10))))
    return tens >= F.size(evaluations)


def study_rows(responses: DataFrame, topics: Sequence[str], seconds: int = 360) -> DataFrame:
    """Responses with feedback, be it empty, that on the topics named took their time and aren't all tens."""
    chosen = F.filter("evaluation_list", lambda e: e["topic"].isin(*topics))
    out = responses.where("qualitative_feedback is not null").withColumn("evaluation_list", chosen).where(F.size("evaluation_list") > 0)
    spent = F.aggregate("evaluation_list", F.lit(0), lambda s, e: s + e["elapsed_seconds"])
    return out.where((spent >= seconds) & ~all_ten(F.col("evaluation_list")))


def study_ratings(responses: DataFrame) -> DataFrame:
    """(username, topic, question, metric, strategy, score), one row a rating."""
    each = responses.select("username", F.explode("evaluation_list").alias("e"))
    metric = each.select("username", "e.topic", "e.question", F.explode("e.evaluation_dict").alias("metric", "scores"))
    return metric.select("username", "topic", "question", "metric", F.explode("scores").alias("strategy", "score"))


def question_means(ratings: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """(metric, question, one mean for each strategy, n)."""
    cols = [F.avg(F.when(F.col("strategy") == s, F.col("score"))).alias(s) for s in strategies]
    return ratings.groupBy("metric", "question").agg(*cols, F.countDistinct("username").alias("n"))
