"""Leave-one-run-out (or grouped k-fold) logistic regression over standardised features, against the majority baseline."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F


def leave_one_out(rows: DataFrame, run: str, label: str, features: list[str], *, folds: int | None = None, reg: float = 2.0) -> DataFrame:
    """(fold, n, accuracy, baseline): each run is left out once and judged by what was fitted on the others.

    With ``folds`` the runs are dealt into so many parts, left out in turn, so that the number of fits doesn't grow with
    the data. ``reg`` is the inverse of the usual C. Rows with a null feature or label are left out; classes weigh the
    same whatever their sizes."""
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in (run, label, *features)))
    rows = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    numbered = rows.select(run).distinct().withColumn("fold", (F.row_number().over(W.orderBy(F.xxhash64(run), run)) - 1).cast("int"))  # a row a run
    if folds is not None:
        numbered = numbered.withColumn("fold", F.col("fold") % folds)
    rows = rows.join(numbered, run)
    out = None
    for fold in [r.fold for r in rows.select("fold").distinct().orderBy("fold").collect()]:  # the runs' numbers, or at most `folds`
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        counts = train.groupBy("y").agg(F.count("*").alias("c"))
        if counts.count() < 2:
            continue
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(train)
        total = train.count()
        weighted = scaler.transform(train).join(F.broadcast(counts), "y").withColumn("w", F.lit(float(total)) / F.col("c"))
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=reg / max(1, total), standardization=False).fit(weighted)
        top = counts.orderBy(F.desc("c"), "y").first().y
        hit = model.transform(scaler.transform(test)).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("y")).cast("double")).alias("accuracy"), F.avg((F.col("y") == top).cast("double")).alias("baseline"))
        hit = hit.select(F.lit(fold).alias("fold"), "n", "accuracy", "baseline")
        out = hit if out is None else out.unionByName(hit)
    return out if out is not None else rows.sparkSession.createDataFrame([], "fold int, n long, accuracy double, baseline double")
