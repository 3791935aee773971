"""Threshold labelling and soft voting over feature scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from pagerisk.functions.encoders import Encoder
from pagerisk.functions.text import fear_prediction
from pagerisk.operators.batches import dense_index
from pagerisk.operators.scoring import FEATURES, Scorer, page_scores, with_property_scores
from pagerisk.operators.similarity import HeadlineCorpus

CLASSIFIER_THRESHOLD = 0.5
LABEL_BATCH = 100
# Relative range up to which a feature counts as constant.
ROUNDING = 1e-12


def _sum(columns):
    return reduce(lambda a, b: a + b, columns)


def label_features(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    threshold: float = CLASSIFIER_THRESHOLD,
    out: str = "label",
) -> DataFrame:
    """1 where the plain mean of the features reaches the threshold."""
    mean = _sum([F.col(f) for f in features]) / len(features)
    return df.withColumn(out, (mean >= threshold).cast("int"))


def label_pages(
    pages: DataFrame,
    corpus: HeadlineCorpus,
    thresholds: Sequence[float],
    encoder: Encoder | None = None,
    scorer: Scorer = fear_prediction,
    classifier_threshold: float = CLASSIFIER_THRESHOLD,
) -> DataFrame:
    """One labelled row per page and similarity threshold.

    The first three features are shared by a page's rows; the nearest headlines are found
    once and only counted per threshold.
    """
    scores = page_scores(pages, corpus, encoder, scorer)
    rows = with_property_scores(scores, list(thresholds))
    return label_features(rows, threshold=classifier_threshold)


def label_pages_in_batches(
    pages: DataFrame,
    corpus: HeadlineCorpus,
    thresholds: Sequence[float],
    batch_size: int = LABEL_BATCH,
    order: str = "page_id",
    **options,
) -> DataFrame:
    """The rows of ``label_pages`` with the batch they belong to, counted from 0.

    Batches hold ``batch_size`` URLs, in the order of the first ``order`` (a number from 0)
    of each URL. Only URLs are numbered, not the pages.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    places = pages.groupBy("url").agg(F.min(order).cast("long").alias("__place"))
    places = places.withColumn("__file", F.expr("__place div 65536"))
    numbered = dense_index(places, "__file", "__place", "__item")
    batch = F.floor(F.col("__item") / batch_size).cast("long").alias("batch")
    labelled = label_pages(pages.select("url", "html"), corpus, thresholds, **options)
    return labelled.join(numbered.select("url", batch), "url")


class Scaler(NamedTuple):
    """Fitted per-feature mean and population deviation, with the voting weights."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]


def scaler_stats(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per feature: mean and scale; a constant feature has the scale 1.

    Constant means that its range is within rounding of its values. The deviation itself
    does not tell, as partial sums leave a rest of rounding errors in it.
    """
    moments = df.agg(
        *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)),
        *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)),
        *(
            (F.max(f) - F.min(f) <= ROUNDING * F.greatest(F.abs(F.max(f)), F.abs(F.min(f)))).alias(
                f"c{i}"
            )
            for i, f in enumerate(features)
        ),
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"c{i}"), 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, f in enumerate(features)
    ]
    return moments.select(F.inline(F.array(*rows)))


def fit_scaler(
    df: DataFrame, features: Sequence[str] = FEATURES, weights: Sequence[float] | None = None
) -> Scaler:
    """Fit on a feature table; equal weights unless given."""
    stats = {row.feature: row for row in scaler_stats(df, features).collect()}
    k = len(features)
    return Scaler(
        tuple(features),
        tuple(stats[f]["mean"] for f in features),
        tuple(stats[f]["scale"] for f in features),
        tuple(float(w) for w in (weights if weights is not None else [1.0 / k] * k)),
    )


def soft_vote(
    df: DataFrame, scaler: Scaler, threshold: float = CLASSIFIER_THRESHOLD
) -> DataFrame:
    """Add the weighted z-score and the label."""
    terms = [
        (F.col(f) - F.lit(m)) / F.lit(s) * F.lit(w)
        for f, m, s, w in zip(scaler.features, scaler.means, scaler.scales, scaler.weights)
    ]
    scored = df.withColumn("vote_score", _sum(terms))
    return scored.withColumn("vote_label", (F.col("vote_score") >= threshold).cast("int"))
