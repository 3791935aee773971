"""The trained fear scorer, with toxic documents standing for fearful headlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.functions.text import FEAR_LABEL, FEAR_WORDS, fear_prediction
from pagerisk.operators import evaluation as E, fear, scoring
from pagerisk.plans.catalog import query, table
from pagerisk.plans.label_queries import is_train_sql
from pagerisk.plans.text_queries import hits_sql, labelled_documents

WORDS_SQL = r"regexp_extract_all(lower(text), '\p{L}+')"
LABELLED_SQL = f"""
  SELECT doc_id, text, toxic AS label, {is_train_sql('doc_id')} AS is_train
  FROM documents JOIN labels USING (doc_id)"""


def weights_sql(labelled: str) -> str:
    """(word, n_fear, n_other, weight, z) of a query of texts and labels."""
    counts = f"""
      SELECT word, count(*) FILTER (WHERE label = 1) AS n_fear,
        count(*) FILTER (WHERE label <> 1) AS n_other
      FROM (SELECT unnest({WORDS_SQL}) AS word, label FROM ({labelled}) WHERE label IS NOT NULL)
      GROUP BY word"""
    return f"""
      SELECT *, weight / sqrt(1 / (n_fear + a) + 1 / (n_other + a)) AS z
      FROM (SELECT word, n_fear, n_other, a,
              ln((n_fear + a) / (total_fear + 1000 - n_fear - a))
              - ln((n_other + a) / (total_other + 1000 - n_other - a)) AS weight
            FROM (SELECT *, (n_fear + n_other) * (1000.0::DOUBLE / (total_fear + total_other)) AS a
                  FROM (SELECT *, sum(n_fear) OVER () AS total_fear,
                          sum(n_other) OVER () AS total_other FROM ({counts}))))"""


def margins_sql(texts: str, weights: str) -> str:
    """(doc_id, margin): the sum of the sure weights of a text's words."""
    return f"""
      SELECT doc_id, coalesce(margin, 0.0) AS margin FROM ({texts}) LEFT JOIN (
        SELECT doc_id, sum(weight) AS margin
        FROM (SELECT doc_id, unnest({WORDS_SQL}) AS word FROM ({texts}))
        JOIN ({weights}) USING (word) WHERE abs(z) >= 1.96 GROUP BY doc_id) USING (doc_id)"""


def _labelled(spark, sf_dir) -> DataFrame:
    rows = labelled_documents(spark, sf_dir).select(
        F.col("idx").alias("doc_id"), F.col("headline").alias("text"),
        F.col("clickbait").alias("truth"),
    )
    return E.split_train_test(rows, "doc_id")


@query(
    f"""SELECT word, n_fear, n_other, round(weight, 6) AS weight, round(z, 6) AS z
       FROM ({weights_sql(LABELLED_SQL)})"""
)
def fear_weights(spark, sf_dir):
    """The weight of every word of the labelled documents."""
    found = fear.fit_fear_weights(_labelled(spark, sf_dir), label="truth")
    return found.select(
        "word", "n_fear", "n_other", F.round("weight", 6).alias("weight"), F.round("z", 6).alias("z")
    )


TRAINED_SQL = weights_sql(f"SELECT * FROM ({LABELLED_SQL}) WHERE is_train")


@query(
    f"""SELECT source, round(coalesce(avg(1 / (1 + exp(-margin))) FILTER (WHERE margin > 0), 0.0), 6)
         AS fear_score
       FROM ({margins_sql('SELECT doc_id, text FROM documents', TRAINED_SQL)})
       JOIN documents USING (doc_id) GROUP BY source"""
)
def fear_score_trained(spark, sf_dir):
    """Fear score per source with weights trained on 70 % of the labelled documents."""
    weights = fear.fit_fear_weights(_labelled(spark, sf_dir).filter("is_train"), label="truth")
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = scoring.fear_score(fear.predict_fear(documents, weights, "doc_id"), "source")
    return found.select("source", F.round("fear_score", 6).alias("fear_score"))


HELD_OUT_SQL = f"SELECT * FROM ({LABELLED_SQL}) WHERE NOT is_train"


@query(
    f"""SELECT model, count(*) AS n_test, sum((said = (label = 1))::INT)::BIGINT AS n_right,
         round(avg((said = (label = 1))::INT), 6) AS accuracy
       FROM (SELECT 'weights' AS model, label, margin > 0 AS said FROM ({HELD_OUT_SQL})
               JOIN ({margins_sql(HELD_OUT_SQL, TRAINED_SQL)}) USING (doc_id)
             UNION ALL
             SELECT 'word list', label, {hits_sql('text', FEAR_WORDS)} > 0 FROM ({HELD_OUT_SQL}))
       GROUP BY model"""
)
def fear_scorer_accuracy(spark, sf_dir):
    """How often the trained weights, and the default word list, are right on held-out documents."""
    rows = _labelled(spark, sf_dir)
    weights = fear.fit_fear_weights(rows.filter("is_train"), label="truth")
    test = rows.filter("not is_train").withColumn("listed", fear_prediction(F.col("text"))["label"])
    scored = fear.predict_fear(test, weights, "doc_id")
    said = F.array(
        F.struct(F.lit("weights").alias("model"), F.col("label").alias("said")),
        F.struct(F.lit("word list").alias("model"), F.col("listed").alias("said")),
    )
    right = ((F.col("said") == FEAR_LABEL) == (F.col("truth") == 1)).cast("int")
    long = scored.select("truth", F.inline(said)).select("model", right.alias("right"))
    return long.groupBy("model").agg(
        F.count("*").alias("n_test"), F.sum("right").alias("n_right"),
        F.round(F.avg("right"), 6).alias("accuracy"),
    )
