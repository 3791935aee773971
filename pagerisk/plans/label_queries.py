"""Clickbait features, labels, votes and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.functions.text import fear_prediction
from pagerisk.operators import evaluation as E, labeling as L, scoring
from pagerisk.operators.scoring import FEATURES
from pagerisk.plans.catalog import query, table
from pagerisk.plans.html_queries import H1_SQL, TEXT_SQL, TITLE_SQL
from pagerisk.plans.text_queries import (
    ENCODER,
    document_corpus,
    error_rate_sql,
    hits_sql,
    labelled_documents,
    nearest_sql,
    page_similarity_sql,
)
from pagerisk.session import materialise, scratch_path, spread

THRESHOLDS = (0.5, 0.75)
# Frequent words of the invented page language; they stand for a fear lexicon.
PAGE_WORDS = ("there", "with", "that", "the", "of", "nicht", "dans", "les", "una", "que")


def page_prediction(text):
    return fear_prediction(text, PAGE_WORDS)


# ---- pages ---------------------------------------------------------------------------

PAGE_TEXTS_SQL = f"SELECT page_id, unnest([{TITLE_SQL}, {H1_SQL}]) AS text FROM pages"


def scored_pages_sql(thresholds) -> str:
    """(page_id, url, threshold, f1..f4) by the SQL twins of the single operators."""
    options = ", ".join(f"CAST({t} AS DOUBLE)" for t in thresholds)
    hits = hits_sql(H1_SQL, PAGE_WORDS)
    return f"""
      SELECT page_id, url, threshold, f1, f2, f3, f4 FROM (
        SELECT page_id, url, similarity AS f1 FROM ({page_similarity_sql()}))
      JOIN (SELECT page_id, CASE WHEN {hits} > 0 THEN {hits} / ({hits} + 1) ELSE 0.0 END AS f2 FROM pages)
        USING (page_id)
      JOIN (SELECT page_id, {error_rate_sql('text')} AS f3
            FROM (SELECT page_id, {TEXT_SQL} AS text FROM pages)) USING (page_id)
      JOIN (SELECT page_id, threshold,
              avg(CAST(coalesce(sim >= threshold AND label = 1, false) AS INTEGER)) AS f4
            FROM (SELECT page_id, text, unnest([{options}]) AS threshold FROM ({PAGE_TEXTS_SQL}))
            LEFT JOIN ({nearest_sql(PAGE_TEXTS_SQL)}) n USING (text)
            GROUP BY page_id, threshold) USING (page_id)"""


ROUNDED_SQL = ", ".join(f"round(f{i + 1}, 6) AS {name}" for i, name in enumerate(FEATURES))
LABELLED_SQL = f"""
  SELECT url, threshold, {ROUNDED_SQL},
    CAST((f1 + f2 + f3 + f4) / 4 >= 0.5 AS INTEGER) AS label
  FROM ({scored_pages_sql(THRESHOLDS)})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in FEATURES})


# Pages times headlines that a task compares, at two strings a page.
PAIRS_PER_TASK = 1 << 31


def pages_against(spark, sf_dir, corpus) -> DataFrame:
    """The pages, in tasks whose length does not grow with the corpus that each page meets."""
    pages = table(spark, sf_dir, "pages")
    if not corpus.small:  # searched in cells of their own
        return spread(pages)
    return spread(pages, -(-pages.count() * corpus.rows // PAIRS_PER_TASK))


def _pages(spark, sf_dir, corpus) -> DataFrame:
    return pages_against(spark, sf_dir, corpus).select("url", "html")


@query(f"SELECT url, {ROUNDED_SQL} FROM ({scored_pages_sql([0.75])})")
def clickbait_features(spark, sf_dir):
    corpus = document_corpus(spark, sf_dir)
    return _rounded(
        scoring.clickbait_features(_pages(spark, sf_dir, corpus), corpus, ENCODER, page_prediction)
    )


@query(LABELLED_SQL)
def label_pages(spark, sf_dir):
    """The flagship: parse, score and label every page at each similarity threshold."""
    corpus = document_corpus(spark, sf_dir)
    return _rounded(
        L.label_pages(_pages(spark, sf_dir, corpus), corpus, THRESHOLDS, ENCODER, page_prediction)
    )


@query(LABELLED_SQL)
def label_pages_large_corpus(spark, sf_dir):
    """The same with a broadcast bound below the corpus size."""
    corpus = document_corpus(spark, sf_dir, broadcast_bytes=16 << 10)
    return _rounded(
        L.label_pages(_pages(spark, sf_dir, corpus), corpus, THRESHOLDS, ENCODER, page_prediction)
    )


@query(
    f"""SELECT l.*, b.batch FROM ({LABELLED_SQL}) l JOIN (
         SELECT url, (row_number() OVER (ORDER BY page_id) - 1) // 100 AS batch FROM pages) b
       USING (url)"""
)
def label_pages_in_batches(spark, sf_dir):
    """The labels with their batches of a hundred pages."""
    corpus = document_corpus(spark, sf_dir)
    pages = pages_against(spark, sf_dir, corpus)
    return _rounded(
        L.label_pages_in_batches(
            pages, corpus, THRESHOLDS, encoder=ENCODER, scorer=page_prediction
        )
    )


@query(LABELLED_SQL)
def labels_csv(spark, sf_dir):
    """Labelled pages written as CSV and read back."""
    from pagerisk.sources.feeds import write_labels_csv

    labelled = label_pages(spark, sf_dir)
    path = scratch_path(spark, "labels-csv")
    write_labels_csv(labelled, path)
    return spark.read.csv(path, schema=labelled.schema, header=True)


# ---- feature rows --------------------------------------------------------------------

USER_FEATURES_SQL = """
  SELECT user_id, avg(CAST(event_type = 'click' AS INTEGER)) AS f1,
    avg(CAST(event_type = 'view' AS INTEGER)) AS f2, avg(value) / 100 AS f3, 0.1::DOUBLE AS f4
  FROM events GROUP BY user_id"""
F_NAMES = ("f1", "f2", "f3", "f4")
WEIGHTS = (0.2, 0.2, 0.2, 0.4)


def user_features(spark, sf_dir) -> DataFrame:
    """Four scores per user, the last one constant."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(
        F.avg((F.col("event_type") == "click").cast("int")).alias("f1"),
        F.avg((F.col("event_type") == "view").cast("int")).alias("f2"),
        (F.avg("value") / 100).alias("f3"),
        F.lit(0.1).alias("f4"),
    )


@query(
    f"""SELECT user_id, round((f1 + f2 + f3 + f4) / 4, 6) AS mean,
         CAST((f1 + f2 + f3 + f4) / 4 >= 0.5 AS INTEGER) AS label FROM ({USER_FEATURES_SQL})"""
)
def label_features(spark, sf_dir):
    labelled = L.label_features(user_features(spark, sf_dir), F_NAMES)
    mean = (F.col("f1") + F.col("f2") + F.col("f3") + F.col("f4")) / 4
    return labelled.select("user_id", F.round(mean, 6).alias("mean"), "label")


SCALER_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, avg({f}) AS mean,
      CASE WHEN max({f}) = min({f}) THEN 1.0 ELSE stddev_pop({f}) END AS scale
    FROM ({USER_FEATURES_SQL})"""
    for f in F_NAMES
)


@query(f"SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM ({SCALER_SQL})")
def fit_scaler(spark, sf_dir):
    stats = L.scaler_stats(user_features(spark, sf_dir), F_NAMES)
    return stats.select(
        "feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale")
    )


SCORE_SQL = " + ".join(
    f"({f} - (SELECT mean FROM s WHERE feature = '{f}'))"
    f" / (SELECT scale FROM s WHERE feature = '{f}') * {w}"
    for f, w in zip(F_NAMES, WEIGHTS)
)


@query(
    f"""WITH s AS ({SCALER_SQL})
       SELECT user_id, round(score, 6) AS vote_score, CAST(score >= 0.5 AS INTEGER) AS vote_label
       FROM (SELECT user_id, {SCORE_SQL} AS score FROM ({USER_FEATURES_SQL}))"""
)
def soft_vote(spark, sf_dir):
    features = materialise(user_features(spark, sf_dir), "vote-features")
    voted = L.soft_vote(features, L.fit_scaler(features, F_NAMES, WEIGHTS))
    return voted.select("user_id", F.round("vote_score", 6).alias("vote_score"), "vote_label")


# ---- evaluation ----------------------------------------------------------------------

PREDICTIONS_SQL = """
  SELECT model, doc_id AS sample_id, toxic AS y_true, y_pred FROM (
    SELECT doc_id, toxic, unnest(['same', 'quality', 'opposite', 'never']) AS model,
      unnest([toxic, quality, 1 - quality, 0]) AS y_pred FROM labels)"""


def metrics_sql(predictions: str) -> str:
    return f"""
      SELECT model, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1, ok / n AS accuracy,
        coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision
      FROM (SELECT model, count(*) AS n, count(*) FILTER (WHERE y_true = y_pred) AS ok,
              count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
              count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
              count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn
            FROM ({predictions}) GROUP BY model)"""


def rule_predictions(spark, sf_dir) -> DataFrame:
    """Four rules predicting toxicity, long form."""
    labels = table(spark, sf_dir, "labels")
    rules = {
        "same": F.col("toxic"),
        "quality": F.col("quality"),
        "opposite": 1 - F.col("quality"),
        "never": F.lit(0),
    }
    rows = [F.struct(F.lit(n).alias("model"), p.alias("y_pred")) for n, p in rules.items()]
    return labels.select(
        F.col("doc_id").alias("sample_id"), F.col("toxic").alias("y_true"), F.inline(F.array(*rows))
    )


@query(
    f"""SELECT model, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
         round(precision, 6) AS precision FROM ({metrics_sql(PREDICTIONS_SQL)})"""
)
def evaluate_models(spark, sf_dir):
    metrics = E.evaluate_models(rule_predictions(spark, sf_dir))
    return metrics.select("model", *(F.round(m, 6).alias(m) for m in ("f1", "accuracy", "precision")))


FAULTY_SQL = f"""
  {PREDICTIONS_SQL}
  UNION ALL SELECT 'partial', doc_id, toxic, quality FROM labels WHERE quality = 1
  UNION ALL SELECT 'count', doc_id, toxic, quality + toxic + 1 FROM labels
  UNION ALL SELECT 'double', doc_id // 8, toxic, quality FROM labels"""


@query(
    f"""SELECT m.model,
         CASE WHEN error IS NULL THEN round(f1, 6) ELSE 'nan'::DOUBLE END AS f1,
         CASE WHEN error IS NULL THEN round(accuracy, 6) ELSE 'nan'::DOUBLE END AS accuracy,
         CASE WHEN error IS NULL THEN round(precision, 6) ELSE 'nan'::DOUBLE END AS precision, error
       FROM (SELECT m.model, CASE WHEN n IS NULL THEN 'no predictions'
               WHEN n <> total THEN n || ' predictions for ' || total || ' samples'
               WHEN samples <> n THEN samples || ' different samples among ' || n || ' predictions'
               WHEN bad > 0 THEN bad || ' predictions are not 0 or 1' END AS error
             FROM (SELECT unnest(['same', 'never', 'partial', 'count', 'double', 'absent']) AS model) m
             LEFT JOIN (SELECT model, count(*) AS n, count(DISTINCT sample_id) AS samples,
                          count(*) FILTER (WHERE y_pred NOT IN (0, 1)) AS bad
                        FROM ({FAULTY_SQL}) GROUP BY model) USING (model)
             CROSS JOIN (SELECT count(*) AS total FROM labels)) m
       LEFT JOIN ({metrics_sql(FAULTY_SQL)}) USING (model)"""
)
def evaluate_models_checked(spark, sf_dir):
    """Two sound models, then one with missing rows, one counting instead of deciding, one
    with repeated samples, one absent."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("sample_id"), F.col("toxic").alias("y_true"), "quality"
    )
    partial = labels.filter("quality = 1").withColumns(
        {"model": F.lit("partial"), "y_pred": F.col("quality")}
    )
    counting = labels.withColumns(
        {"model": F.lit("count"), "y_pred": F.col("quality") + F.col("y_true") + 1}
    )
    predictions = rule_predictions(spark, sf_dir)
    double = labels.withColumns(
        {"model": F.lit("double"), "y_pred": F.col("quality"), "sample_id": F.expr("sample_id div 8")}
    )
    for faulty in (partial, counting, double):
        predictions = predictions.unionByName(faulty.select(*predictions.columns))
    metrics = E.evaluate_models_checked(
        predictions, ["same", "never", "partial", "count", "double", "absent"], labels.count()
    )
    return metrics.select(
        "model", *(F.round(m, 6).alias(m) for m in ("f1", "accuracy", "precision")), "error"
    )


def is_train_sql(key: str) -> str:
    return f"('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT % 100 < 70"


@query(f"SELECT doc_id, {is_train_sql('doc_id')} AS is_train FROM documents")
def split_train_test(spark, sf_dir):
    """Every document's side of a seeded 70/30 split."""
    marked = E.split_train_test(table(spark, sf_dir, "documents"), "doc_id")
    return marked.select("doc_id", "is_train")


def document_features(spark, sf_dir) -> DataFrame:
    """Numeric features of the labelled documents, for training."""
    documents = labelled_documents(spark, sf_dir)
    text = F.col("headline")
    return documents.select(
        F.col("idx").alias("doc_id"),
        F.col("clickbait").cast("double").alias("label"),
        F.log1p(F.length(text)).alias("log_length"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("double").alias("shouts"),
        F.regexp_count(text, F.lit(r"\n")).cast("double").alias("lines"),
        F.regexp_count(text, F.lit(r"\d")).cast("double").alias("digits"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("double").alias("capitals"),
        *(
            F.regexp_count(F.lower(text), F.lit(w)).cast("double").alias(w)
            for w in ("idiot", "moron", "scum", "trash", "clown", "worthless", "loser", "stupid")
        ),
    )


ALGORITHMS_SQL = "(SELECT unnest(['Random Forest', 'Boosted Trees', 'Bagged SVM']) AS model)"
SIDES_SQL = f"(SELECT doc_id, toxic, {is_train_sql('doc_id')} AS is_train FROM labels)"
# What the models must reach on the test side; the invented insults are easy to learn.
ACCURACY_FLOOR = 0.75


def _trained(spark, sf_dir):
    """(models, split rows with features) of the labelled documents."""
    from pagerisk.operators import training as M

    raw = document_features(spark, sf_dir)
    names = [c for c in raw.columns if c not in ("doc_id", "label")]
    split = E.split_train_test(materialise(raw, "training-rows"), "doc_id")
    rows = M.assemble(split, names).select("doc_id", "label", "features", "is_train")
    train = rows.filter("is_train")
    models = {a: M.train_label_model(train, a, trees=10, bags=3, max_iter=5) for a in M.ALGORITHMS}
    return models, rows


@query(
    f"""SELECT model, doc_id AS sample_id, toxic AS y_true, true AS decided
       FROM {SIDES_SQL}, {ALGORITHMS_SQL} WHERE NOT is_train"""
)
def model_predictions(spark, sf_dir):
    """The predictions of three trained models on the test side, in long form."""
    from pagerisk.operators import training as M

    models, rows = _trained(spark, sf_dir)
    found = M.predictions_of(models, rows.filter("not is_train"), "doc_id", "label")
    return found.select("model", "sample_id", "y_true", F.col("y_pred").isin(0, 1).alias("decided"))


@query(
    f"""SELECT model, count(*) FILTER (WHERE is_train) AS n_train,
         count(*) FILTER (WHERE NOT is_train) AS n_test,
         count(*) FILTER (WHERE NOT is_train) AS n_predictions,
         true AS metrics_agree, true AS reloaded_agrees, true AS above_floor
       FROM {SIDES_SQL}, {ALGORITHMS_SQL} GROUP BY model"""
)
def trained_models(spark, sf_dir):
    """Three algorithms trained on 70 % of the labelled documents, checked on the rest.

    metrics_agree: the metrics equal those counted from the written predictions.
    reloaded_agrees: the models, saved and loaded, predict the same. above_floor: the
    accuracy reaches ACCURACY_FLOOR.
    """
    from pagerisk.operators import training as M

    models, rows = _trained(spark, sf_dir)
    test = rows.filter("not is_train")
    found = materialise(M.predictions_of(models, test, "doc_id", "label"), "predictions")
    path = scratch_path(spark, "models")
    loaded = {}
    for place, (name, model) in enumerate(models.items()):
        M.save_model(model, f"{path}/{place}")
        loaded[name] = M.load_model(spark, f"{path}/{place}")
    again = M.predictions_of(loaded, test, "doc_id", "label").withColumnRenamed("y_pred", "again")
    right = F.avg((F.col("y_pred") == F.col("y_true")).cast("int"))
    facts = (
        found.join(again.drop("y_true"), ["model", "sample_id"])
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("n_predictions"),
            F.min(F.col("again") == F.col("y_pred")).alias("reloaded_agrees"),
            right.alias("right"),
        )
    )
    sides = rows.agg(
        F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test")
    ).first()
    return facts.join(E.evaluate_models(found), "model").select(
        "model",
        F.lit(sides.n_train).alias("n_train"),
        F.lit(sides.n_test).alias("n_test"),
        "n_predictions",
        (F.abs(F.col("right") - F.col("accuracy")) < 1e-9).alias("metrics_agree"),
        "reloaded_agrees",
        (F.col("accuracy") >= ACCURACY_FLOOR).alias("above_floor"),
    )
