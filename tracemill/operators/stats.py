"""Statistics over runs: resampling with draws spread over the cluster, exact sign flips, distances.

The inputs are one row a run or case, aggregated before; each draw is a grouped sum over them, so nothing is
collected and draws run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def l1(p: str, q: str) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)


def jensen_shannon(p: str, q: str) -> Column:
    """Jensen-Shannon divergence in bits of two distributions held as arrays."""
    part = lambda a, b: F.when(a > 0, a * F.log2(a / ((a + b) / 2))).otherwise(0.0)
    return F.aggregate(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2), F.lit(0.0), lambda s, x: s + x)


def eta_squared(rows: DataFrame, value: str, group: str) -> DataFrame:
    """Variance between groups as a share of all."""
    whole = rows.agg(F.avg(value).alias("mu"), (F.var_pop(value) * F.count("*")).alias("sst"))
    cells = rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    return cells.crossJoin(F.broadcast(whole)).agg(F.round(F.try_divide(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), F.lit(2))), F.max("sst")), 6).alias("eta2"))


def _draws(rows: DataFrame, draws: int) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(draws).withColumnRenamed("id", "draw")))  # a fixed number of draws


def _digest(*seed: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *seed))


def _uniform(*seed: Column | str) -> Column:
    """A uniform number that depends on its arguments only: 52 bits of their MD5, which any engine can compute."""
    return F.conv(F.substring(_digest(*seed), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


#: Cumulative probabilities of Poisson(1).
POISSON = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815)


def bootstrap_mean(rows: DataFrame, value: str, *, key: str, draws: int = 20_000, seed: int = 1) -> DataFrame:
    """(n, mean, low, high, positive): mean with a 95 % interval by Poisson bootstrap, and the share of draws above
    zero, ties half; draws that take no row count for nothing. Weights depend on key, draw and seed only, so results repeat on any cluster."""
    u = _uniform(key, "draw", F.lit(seed))
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    d = _draws(rows.where(F.col(value).isNotNull()), draws).withColumn("w", weight).groupBy("draw").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    est = rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    got = d.where("m is not null").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.avg(F.when(F.col("m") > 1e-12, 1.0).when(F.col("m") >= -1e-12, 0.5).otherwise(0.0)).alias("positive"))
    return est.crossJoin(got)


def permutation(rows: DataFrame, value: str, group: str, *, key: str, draws: int = 1000, seed: int = 1) -> DataFrame:
    """(difference, p): mean of group true less that of false, and (k + 1) / (draws + 1) by shuffled labels.

    A shuffle ranks each row by a hash of key and draw; the first as many as the true group has are labelled true.
    """
    from pyspark.sql import Window as W

    obs = rows.agg(F.count(F.when(F.col(group), 1)).alias("k"), (F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("difference"))
    d = _draws(rows, draws).withColumn("r", F.row_number().over(W.partitionBy("draw").orderBy(_digest(key, "draw", F.lit(seed)))))
    d = d.crossJoin(F.broadcast(obs)).groupBy("draw").agg((F.avg(F.when(F.col("r") <= F.col("k"), F.col(value))) - F.avg(F.when(F.col("r") > F.col("k"), F.col(value)))).alias("m"), F.first("difference").alias("difference"))
    return d.groupBy("difference").agg(((F.count(F.when(F.abs(F.col("m")) >= F.abs(F.col("difference")) - 1e-9, 1)) + 1) / (F.count("*") + 1)).alias("p"))


def signflip(rows: DataFrame, value: str, *, key: str, exact: int = 16, draws: int = 20_000, seed: int = 1) -> DataFrame:
    """(n, observed, p): two-sided sign-flip test of a mean. Up to ``exact`` non-zero values all sign patterns are
    counted, beyond that ``draws`` random ones."""
    v = rows.where(F.col(value).isNotNull())
    n = v.count()
    obs = v.agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    if n <= exact:
        from pyspark.sql import Window as W

        v = v.withColumn("bit", F.row_number().over(W.orderBy(key)) - 1)  # at most `exact` rows
        sign = F.when(F.expr("shiftrightunsigned(draw, bit) & 1") == 1, 1.0).otherwise(-1.0)
        patterns = 2**n
    else:
        sign = F.when(_uniform(key, "draw", F.lit(seed)) < 0.5, 1.0).otherwise(-1.0)
        patterns = draws
    d = _draws(v, patterns).groupBy("draw").agg(F.sum(sign * F.col(value)).alias("s")).crossJoin(F.broadcast(obs))
    return d.groupBy("n", F.try_divide(F.col("total"), F.col("n")).alias("observed")).agg(F.avg((F.abs(F.col("s")) >= F.abs(F.col("total")) - 1e-9).cast("double")).alias("p"))
