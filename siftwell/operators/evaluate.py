"""Evaluation of verdicts against labels: confusion, metrics, AUC, thresholds, splits, cost and unions of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.rollup import bundle_verdicts


def confusion(rows: DataFrame, threshold: int = 2, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn of rows (positive boolean, verdict rank); detected from the threshold rank on."""
    hit = F.col("verdict") >= threshold
    return rows.groupBy(*(by or [])).agg(
        F.count_if(F.col("positive") & hit).alias("tp"), F.count_if(~F.col("positive") & hit).alias("fp"), F.count_if(F.col("positive") & ~hit).alias("fn"), F.count_if(~F.col("positive") & ~hit).alias("tn")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def metrics(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, specificity, f1 and balanced_accuracy; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r, s = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return counts.withColumns({"precision": p, "recall": r, "specificity": s, "f1": _ratio(2 * p * r, p + r), "balanced_accuracy": (r + s) / 2})


def _running(per: DataFrame, parts: int = 200) -> DataFrame:
    """per (score, n; a row a score) with before, the sum of n of smaller scores, and total.

    Scores are cut at quantiles. One window runs within each part and one over
    the parts' sums, at most `parts` rows, so no task holds all scores.
    """
    cuts = per.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 50 * parts))
    cut = per.withColumn("_cuts", cuts.scalar()).withColumn("_part", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("score"))), F.lit(0))).drop("_cuts")
    sums = cut.groupBy("_part").agg(F.sum("n").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_part", earlier.alias("_earlier"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("_within", within).join(F.broadcast(sums), "_part").withColumn("before", F.col("_earlier") + F.col("_within")).drop("_part", "_earlier", "_within")


def auc(rows: DataFrame) -> DataFrame:
    """One row: area under the curve of rows (positive, score) by mid-ranks of the distinct scores. Counts of a score are summed first."""
    per = rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.expr("positive")).alias("p"))
    ranked = _running(per).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    total = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return total.select(F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auc"))


def threshold_at_rate(rows: DataFrame, rate: float) -> DataFrame:
    """One row: the score of the negative at place floor(rate * n) + 1 from the top, by counts of distinct scores."""
    per = rows.filter(~F.col("positive")).groupBy("score").agg(F.count("*").alias("n"))
    return _running(per).filter(F.col("total") - F.col("before") >= F.floor(F.col("total") * rate) + 1).agg(F.max("score").alias("threshold"))


def split_of(key: Column) -> Column:
    """train, train, val or test by the first byte of sha256 of the key, modulo 4."""
    part = F.conv(F.substring(F.sha2(key, 256), 1, 2), 16, 10).cast("int") % 4
    return F.when(part < 2, "train").when(part == 2, "val").otherwise("test")


def cost(rows: DataFrame, usd_per_million: float) -> DataFrame:
    """One row from (judge_bytes, judge_tokens nullable): tokens (reported, else a quarter of the bytes), usd, usd per 1000 rows."""
    tokens = F.coalesce(F.col("judge_tokens"), F.floor(F.col("judge_bytes") / 4.0 + 0.5)).cast("long")
    total = rows.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count("*").alias("n"))
    usd = F.col("tokens") / 1e6 * usd_per_million
    return total.select("tokens", "n", usd.alias("usd"), F.when(F.col("n") > 0, usd / F.col("n") * 1000).otherwise(0.0).alias("usd_per_1000"))


def union_of_arms(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and the worse verdict of two arms; a bundle missing from the second keeps the first's."""
    return a.select(key, F.col("verdict").alias("va")).join(b.select(key, F.col("verdict").alias("vb")), key, "left").select(key, F.greatest(F.col("va"), F.coalesce("vb", F.lit(0))).alias("verdict"))


def delta_of_arms(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many bundles that both arms have are worse, better or the same in the first."""
    both = a.select(key, F.col("verdict").alias("va")).join(b.select(key, F.col("verdict").alias("vb")), key)
    return both.agg(F.count_if(F.expr("va > vb")).alias("worse"), F.count_if(F.expr("va < vb")).alias("better"), F.count_if(F.expr("va = vb")).alias("same"))


def arm_alone(arm: DataFrame, findings: DataFrame, static: DataFrame, own: Column) -> DataFrame:
    """bundle_id, verdict, ms and mismatch of a tool without the rules, from the arm in which both ran.

    arm has (bundle_id, ms), static (bundle_id, verdict, ms), a row a bundle.
    verdict is what the arm's own findings earn, ms the arm's time less that of
    static, never below 0. mismatch: whether the arm's other findings earn another
    verdict than static did; false where static lacks the bundle.
    """
    mine = bundle_verdicts(arm, findings.filter(own)).select("bundle_id", "verdict")
    rest = bundle_verdicts(arm, findings.filter(~own)).select("bundle_id", F.col("verdict").alias("_rest"))
    base = static.select("bundle_id", F.col("verdict").alias("_static"), F.col("ms").alias("_static_ms"))
    rows = arm.select("bundle_id", "ms").join(mine, "bundle_id").join(rest, "bundle_id").join(base, "bundle_id", "left")
    ms = F.greatest(F.lit(0), F.col("ms") - F.coalesce("_static_ms", F.lit(0)))
    return rows.select("bundle_id", "verdict", ms.alias("ms"), F.coalesce(F.col("_static") != F.col("_rest"), F.lit(False)).alias("mismatch"))


def with_static(static: DataFrame, alone: DataFrame) -> DataFrame:
    """bundle_id, verdict and ms of both together: the worse verdict and the times added; a bundle that the tool lacks keeps static's."""
    other = alone.select("bundle_id", F.col("verdict").alias("_v"), F.col("ms").alias("_ms"))
    rows = static.join(other, "bundle_id", "left")
    return rows.select("bundle_id", F.greatest("verdict", F.coalesce("_v", F.lit(0))).alias("verdict"), (F.col("ms") + F.coalesce("_ms", F.lit(0))).alias("ms"))
