"""Per-page clickbait features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pagerisk.functions.encoders import Encoder, TrigramEncoder, text_vector
from pagerisk.functions.html import page_elements
from pagerisk.functions.text import FEAR_LABEL, cosine01, fear_prediction, grammar_error_rate
from pagerisk.operators.pages import flat_headings, sentences
from pagerisk.operators.similarity import (
    PROPERTY_THRESHOLD,
    HeadlineCorpus,
    is_property,
    nearest_headline,
    page_vectors,
    property_share,
    with_url_texts,
)
from pagerisk.session import materialise

FEATURES = (
    "url_html_similarity_score",
    "fear_mongering_score",
    "grammatical_errors_score",
    "additional_properties_score",
)
Scorer = Callable[[Column], Column]


def fear_score(predictions: DataFrame, page: str, pages: DataFrame | None = None) -> DataFrame:
    """Mean score of the headings labelled fear-mongering, 0.0 where there is none.

    ``predictions`` holds (page, label, score) per heading; ``pages`` adds pages without any.
    """
    positive = F.avg(F.when(F.col("label") == FEAR_LABEL, F.col("score")))
    scored = predictions.groupBy(page).agg(F.coalesce(positive, F.lit(0.0)).alias("fear_score"))
    if pages is None:
        return scored
    return pages.select(page).join(scored, page, "left").fillna(0.0, ["fear_score"])


def fear_score_of(headings: Column, scorer: Scorer = fear_prediction) -> Column:
    """The same over an array of headings within one row."""
    positive = F.filter(F.transform(headings, lambda h: scorer(h)), lambda p: p["label"] == FEAR_LABEL)
    total = F.aggregate(positive, F.lit(0.0), lambda acc, p: acc + p["score"])
    return F.coalesce(F.try_divide(total, F.size(positive)), F.lit(0.0))


def grammar_scores(df: DataFrame, text: str, out: str = "grammar_error_rate") -> DataFrame:
    """Errors per sentence of a text column."""
    split = df.withColumn("__sentences", sentences(F.col(text)))
    return split.withColumn(out, grammar_error_rate("__sentences")).drop("__sentences")


def property_texts(page: str = "page") -> Column:
    """Title, meta contents and headings of a page with headings, else its title alone."""
    title = F.array(f"{page}.title")
    full = F.concat(title, F.map_values(f"{page}.meta"), F.col(f"{page}.headings.text"))
    return F.when(F.size(f"{page}.headings") > 0, full).otherwise(title)


def page_scores(
    pages: DataFrame,
    corpus: HeadlineCorpus,
    encoder: Encoder | None = None,
    scorer: Scorer = fear_prediction,
) -> DataFrame:
    """Threshold-free scores per page: the first three features and the nearest headlines.

    Every page is parsed once and scored where it is: no shuffle. Only a corpus too large to
    broadcast is searched afterwards, for the distinct strings of the written scores.
    ``url`` identifies a page.
    """
    encoder = encoder or TrigramEncoder()
    keep = [c for c in pages.columns if c != "html"]
    parsed = pages.withColumn(
        "page", page_elements(F.col("html"), ["title", "headings", "meta", "text"])
    ).drop("html")
    texts = with_url_texts(parsed, "url", "url_texts").select(
        *keep,
        "url_texts",
        F.col("page.headings.text").alias("headings"),
        flat_headings().alias("content"),
        property_texts().alias("property_texts"),
        sentences(F.col("page.text")).alias("sentences"),
    )
    vectors = texts.withColumn(
        "__v",
        page_vectors(
            F.col("content"), F.col("url_texts"), F.col("property_texts"), encoder, corpus
        ),
    )
    scores = vectors.select(
        *keep,
        F.coalesce(cosine01("__v.content", "__v.url"), F.lit(0.0)).alias(FEATURES[0]),
        F.coalesce(fear_score_of(F.col("headings"), scorer), F.lit(0.0)).alias(FEATURES[1]),
        F.coalesce(grammar_error_rate("sentences"), F.lit(0.0)).alias(FEATURES[2]),
        F.col("__v.nearest") if corpus.small else F.col("property_texts"),
    )
    if corpus.small:
        return scores
    return _with_nearest(materialise(scores, "page-scores"), corpus, encoder)


def _with_nearest(scores: DataFrame, corpus: HeadlineCorpus, encoder: Encoder) -> DataFrame:
    """Replace ``property_texts`` by ``nearest``, the nearest headline of each of its strings.

    Equal lists and equal strings are brought together before anything is compared.
    """
    keyed = scores.withColumn("__list", F.md5(F.to_json(F.struct("property_texts"))))
    lists = keyed.groupBy("__list").agg(F.any_value("property_texts").alias("texts"))
    strings = lists.select("__list", F.posexplode_outer("texts").alias("pos", "text"))
    strings = materialise(strings, "property-strings")
    distinct = strings.select("text").filter(F.col("text").isNotNull()).distinct()
    nearest = nearest_headline(
        distinct.withColumn("embedding", text_vector(F.col("text"), encoder)), corpus, "text"
    )
    best = F.struct("sim", "label", "idx")
    found = strings.join(nearest.drop("embedding"), "text", "left")
    in_order = F.sort_array(
        F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", best.alias("best"))))
    )
    arrays = found.groupBy("__list").agg(F.transform(in_order, lambda e: e["best"]).alias("nearest"))
    return keyed.join(arrays, "__list").select(
        *(c for c in scores.columns if c != "property_texts"), "nearest"
    )


def with_property_scores(
    scores: DataFrame, thresholds: list[float], threshold_col: str = "threshold"
) -> DataFrame:
    """One row per page and threshold with the fourth feature."""
    options = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = scores.withColumn(threshold_col, F.explode(options))
    share = property_share(F.col("nearest"), F.col(threshold_col))
    return rows.withColumn(FEATURES[3], share).drop("nearest")


def clickbait_features(
    pages: DataFrame,
    corpus: HeadlineCorpus,
    encoder: Encoder | None = None,
    scorer: Scorer = fear_prediction,
    threshold: float = PROPERTY_THRESHOLD,
) -> DataFrame:
    """The four feature scores per page, in the order of ``FEATURES``."""
    scores = page_scores(pages, corpus, encoder, scorer)
    return with_property_scores(scores, [threshold]).drop("threshold")
