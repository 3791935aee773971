"""Classifier metrics from a long prediction table (model, sample_id, y_true, y_pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def evaluate_models(predictions: DataFrame) -> DataFrame:
    """F1, accuracy and precision of the positive class per model; empty denominators give 0."""
    y, p = F.col("y_true"), F.col("y_pred")
    counts = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if(y == p).alias("right"),
    )
    return counts.select(
        "model",
        _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        _ratio(F.col("right"), F.col("n")).alias("accuracy"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def evaluate_models_checked(
    predictions: DataFrame, models: list[str], n_samples: int
) -> DataFrame:
    """Metrics of the named models; a faulty one gets NaN metrics and an error text.

    Faulty: another number of rows than samples, a sample that comes twice, or a prediction
    that is not 0 or 1.
    """
    if not models:
        raise ValueError("name at least one model")
    spark = predictions.sparkSession
    valid = F.coalesce(F.col("y_pred").isin(0, 1) & F.col("y_true").isin(0, 1), F.lit(False))
    checks = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~valid).alias("bad"),
        F.count_distinct("sample_id").alias("samples"),
    )
    named = spark.createDataFrame([(m,) for m in dict.fromkeys(models)], "model string")
    joined = named.join(checks, "model", "left").join(evaluate_models(predictions), "model", "left")
    error = (
        F.when(F.col("n").isNull(), F.lit("no predictions"))
        .when(
            F.col("n") != n_samples,
            F.format_string(f"%d predictions for {n_samples} samples", F.col("n")),
        )
        .when(
            F.col("samples") != F.col("n"),
            F.format_string("%d different samples among %d predictions", "samples", "n"),
        )
        .when(F.col("bad") > 0, F.format_string("%d predictions are not 0 or 1", F.col("bad")))
    )
    marked = joined.withColumn("error", error)
    return marked.select(
        "model",
        *(
            F.when(F.col("error").isNull(), F.col(m)).otherwise(F.lit(float("nan"))).alias(m)
            for m in ("f1", "accuracy", "precision")
        ),
        "error",
    )


def split_train_test(
    df: DataFrame, key: str, train_percent: int = 70, seed: int = 42, out: str = "is_train"
) -> DataFrame:
    """Mark a seeded share of the keys; the same key always falls on the same side.

    The side comes from the first 32 bits of the MD5 of "seed:key", so any system can tell it.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    return df.withColumn(out, bucket < train_percent)
