"""A fear scorer that is trained: weighted words instead of a fixed list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.functions.text import FEAR_LABEL, NO_FEAR_LABEL
from pagerisk.session import materialise

# Words further from zero than this many standard deviations have a say.
SURE = 1.96
PRIOR_WORDS = 1000.0


def words_of(text: Column) -> Column:
    """Runs of letters, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def fit_fear_weights(
    labelled: DataFrame, text: str = "text", label: str = "label", prior_words: float = PRIOR_WORDS
) -> DataFrame:
    """Log-odds of every word between fearful and other texts, under a Dirichlet prior.

    ``labelled`` holds texts with 0/1 labels; rows without a label or text say nothing. The
    prior is ``prior_words`` words dealt as in all the labelled text, so rare words stay near
    zero. Returns word, n_fear, n_other, weight (the difference of the two log-odds) and z
    (weight over its standard deviation). Counts are combined before the shuffle; only the
    two totals reach the driver.
    """
    fear = F.col(f"`{label}`") == 1
    rows = labelled.filter(F.col(f"`{label}`").isNotNull()).select(
        F.explode(words_of(F.col(f"`{text}`"))).alias("word"), fear.alias("fear")
    )
    counts = rows.groupBy("word").agg(
        F.count_if("fear").alias("n_fear"), F.count_if(~F.col("fear")).alias("n_other")
    )
    counts = materialise(counts, "fear-words")
    totals = counts.agg(F.sum("n_fear").alias("fear"), F.sum("n_other").alias("other")).first()
    n_fear, n_other = totals.fear or 0, totals.other or 0
    share = prior_words / max(n_fear + n_other, 1)
    prior = (F.col("n_fear") + F.col("n_other")) * F.lit(share)

    def log_odds(count: Column, total: int) -> Column:
        return F.log((count + prior) / (F.lit(total + prior_words) - count - prior))

    weight = log_odds(F.col("n_fear"), n_fear) - log_odds(F.col("n_other"), n_other)
    spread = F.sqrt(1 / (F.col("n_fear") + prior) + 1 / (F.col("n_other") + prior))
    # A word that is all there is has no odds.
    known = F.coalesce(weight, F.lit(0.0))
    return counts.select(
        "word", "n_fear", "n_other", known.alias("weight"), (known / spread).alias("z")
    )


def predict_fear(
    texts: DataFrame, weights: DataFrame, key: str, text: str = "text", sure: float = SURE
) -> DataFrame:
    """Label and confidence of every text by the weights of its words, repeats counted.

    ``key`` identifies a text. Fearful is what sums above zero; the confidence is the
    logistic of the distance from zero, a half where no sure word occurs or the text is NULL.
    Returns the columns of ``texts`` with label, score and margin (the sum), which take the
    place of columns of these names; ``fear_score`` takes it as it is. Texts meet the weights
    by word after their own repeats are counted; a frequent word has one row of weights, so
    its texts may be split over tasks.
    """
    sure_words = weights.filter(F.abs("z") >= sure).select("word", "weight")
    counted = (
        texts.select(F.col(f"`{key}`").alias("__key"), F.explode(words_of(F.col(f"`{text}`"))).alias("word"))
        .groupBy("__key", "word")
        .agg(F.count("*").alias("times"))
    )
    sums = (
        counted.join(sure_words, "word")
        .groupBy("__key")
        .agg(F.sum(F.col("times") * F.col("weight")).alias("__margin"))
    )
    kept = [c for c in texts.columns if c not in ("label", "score", "margin")]
    joined = texts.select(*(f"`{c}`" for c in kept), F.col(f"`{key}`").alias("__key")).join(
        sums, "__key", "left"
    )
    margin = F.coalesce("__margin", F.lit(0.0))
    return joined.select(
        *(f"`{c}`" for c in kept),
        F.when(margin > 0, FEAR_LABEL).otherwise(NO_FEAR_LABEL).alias("label"),
        (1 / (1 + F.exp(-F.abs(margin)))).alias("score"),
        margin.alias("margin"),
    )
