"""Text scoring and similarity over documents, pages and stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagerisk.functions.encoders import TrigramEncoder
from pagerisk.functions.text import (
    BRACKETS,
    FEAR_LABEL,
    GRAMMAR_PATTERNS,
    NO_FEAR_LABEL,
    fear_prediction,
)
from pagerisk.operators import pages as H, scoring, similarity as S
from pagerisk.plans.catalog import heavy_table, query, table
from pagerisk.plans.html_queries import (
    BATCH_CONTENT_SQL,
    CONTENT_BATCHES,
    H1_SQL,
    TEXT_SQL,
    TITLE_SQL,
    pages_of_batches,
    sentences_sql,
)
from pagerisk.plans.url_queries import URL_PARTS_SQL

ENCODER = TrigramEncoder()
SMALL_ENCODER = TrigramEncoder("hashed-trigrams-32", 32)
# Insults that occur in the documents; they stand for a lexicon a deployment would supply.
HOSTILE_WORDS = (
    "idiot", "moron", "scum", "trash", "clown", "worthless", "pathetic", "loser", "stupid",
    "disgusting",
)


def hostile_prediction(text):
    return fear_prediction(text, HOSTILE_WORDS)


# ---- SQL twins -----------------------------------------------------------------------


def slots_sql(texts: str, dim: int = 64) -> str:
    """(text, slot, x): the non-zero vector components of the distinct texts of a query."""
    return f"""
      SELECT text, CAST(h % {dim} AS INTEGER) AS slot,
        sum(CASE WHEN (h // {dim}) % 2 = 1 THEN -n ELSE n END)::DOUBLE AS x
      FROM (SELECT text, n, ('0x' || substr(md5(g), 1, 8))::UBIGINT AS h
            FROM (SELECT text, g, count(*) AS n
                  FROM (SELECT text, unnest(list_transform(range(1, length(p) - 1),
                          lambda i: substr(p, i, 3))) AS g
                        FROM (SELECT DISTINCT text, ' ' || lower(text) || ' ' AS p FROM ({texts})))
                  GROUP BY text, g))
      GROUP BY text, slot"""


def vectors_sql(texts: str) -> str:
    """(text, embedding) of the distinct texts that have a non-zero component."""
    return f"""
      SELECT text, list_transform(range(64), lambda i: coalesce(m[i][1], 0)) AS embedding
      FROM (SELECT text, map(list(slot), list([x])) AS m FROM ({slots_sql(texts)}) GROUP BY text)"""


COSINE_SQL = (
    "(list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding,"
    " a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))) + 1) / 2"
)


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def hits_sql(text: str, words=HOSTILE_WORDS) -> str:
    return rf"len(list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}]+'), lambda w: w IN {_in(words)}))"


def _occurrences(char: str) -> str:
    return f"(length(s) - length(replace(s, '{char}', '')))"


def errors_sql(text: str) -> str:
    """Grammar errors summed over the sentences of a text; the sentence is ``s``."""
    rules = [f"len(regexp_extract_all(s, '{p}'))" for p in GRAMMAR_PATTERNS]
    rules += [
        f"CASE WHEN {_occurrences(a)} <> {_occurrences(b)} THEN 1 ELSE 0 END" for a, b in BRACKETS
    ]
    rules.append(f"{_occurrences(chr(34))} % 2")
    w = "string_split(lower(s), ' ')"
    rules.append(
        f"len(list_filter(range(2, len({w}) + 1), lambda i: {w}[i] = {w}[i - 1]"
        rf" AND regexp_full_match({w}[i], '\p{{L}}+')))"
    )
    return f"list_transform({sentences_sql(text)}, lambda s: {' + '.join(rules)})"


def error_rate_sql(text: str) -> str:
    errors = errors_sql(text)
    return f"CASE WHEN len({errors}) > 0 THEN list_sum({errors}) / len({errors}) ELSE 0.0 END"


def page_similarity_sql(dim: int = 64) -> str:
    """(page_id, url, similarity) of the URL parts and title plus heading."""
    texts = f"""
      SELECT page_id, 'c' AS side, unnest([{TITLE_SQL}, {H1_SQL}]) AS text FROM pages
      UNION ALL SELECT page_id, 'u', unnest([coalesce(nullif(path, ''), '/'), coalesce(query, ''), host])
      FROM ({URL_PARTS_SQL})"""
    return f"""
      SELECT p.page_id, p.url, coalesce((try_cast(dot AS DOUBLE) / (sqrt(cc) * sqrt(uu)) + 1) / 2, 0.0)
        AS similarity
      FROM pages p LEFT JOIN (
        SELECT page_id, sum(c * u) AS dot, nullif(sum(c * c), 0) AS cc, nullif(sum(u * u), 0) AS uu
        FROM (SELECT page_id, slot, coalesce(sum(x) FILTER (WHERE side = 'c'), 0) AS c,
                coalesce(sum(x) FILTER (WHERE side = 'u'), 0) AS u
              FROM ({texts}) t JOIN ({slots_sql(f"SELECT text FROM ({texts})", dim)}) v USING (text)
              GROUP BY page_id, slot)
        GROUP BY page_id) USING (page_id)"""


# ---- vectors -------------------------------------------------------------------------


EMBEDDED_SQL = f"""
  SELECT doc_id, coalesce(norm2, 0.0) AS norm2, coalesce(checksum, 0.0) AS checksum
  FROM documents LEFT JOIN (
    SELECT text, sum(x * x) AS norm2, sum(x * slot) AS checksum
    FROM ({slots_sql('SELECT text FROM documents')}) GROUP BY text) USING (text)"""


def _embedded(spark, sf_dir, dedupe: bool) -> DataFrame:
    """Vectors of all documents, reported by squared norm and a position checksum."""
    documents = heavy_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = S.embed_texts(documents, "text", ENCODER, dedupe=dedupe)
    weighted = F.transform("embedding", lambda x, i: x * i)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return encoded.select(
        "doc_id",
        total(F.transform("embedding", lambda x: x * x)).alias("norm2"),
        total(weighted).alias("checksum"),
    )


@query(EMBEDDED_SQL)
def embed_texts(spark, sf_dir):
    return _embedded(spark, sf_dir, dedupe=False)


@query(EMBEDDED_SQL)
def embed_distinct_texts(spark, sf_dir):
    """The same, equal documents of the whole table being encoded once."""
    return _embedded(spark, sf_dir, dedupe=True)


MEANS_SQL = """
  SELECT label, pos, avg(x::DOUBLE) AS mean FROM (
    SELECT label, unnest(range(64)) AS pos, unnest(embedding) AS x FROM embeddings)
  GROUP BY label, pos"""


@query(f"SELECT label, CAST(pos AS INTEGER) AS pos, round(mean, 6) AS mean FROM ({MEANS_SQL})")
def mean_vector(spark, sf_dir):
    """Mean vector per label."""
    means = S.mean_vector(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    rows = means.select("label", F.posexplode("mean").alias("pos", "mean"))
    return rows.withColumn("mean", F.round("mean", 6))


@query(
    f"""SELECT vec_id, round({COSINE_SQL}, 6) AS similarity
       FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings) a
       JOIN (SELECT label, list(mean ORDER BY pos) AS embedding FROM ({MEANS_SQL}) GROUP BY label) b
       USING (label)"""
)
def cosine_to_mean(spark, sf_dir):
    """Similarity of every vector to the mean of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    means = S.mean_vector(vectors, ["label"], "embedding")
    compared = S.with_cosine01(vectors.join(means, "label"), "embedding", "mean")
    return compared.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""SELECT page_id, round(similarity, 6) AS similarity, similarity >= 0.5 AS match
       FROM ({page_similarity_sql()})"""
)
def url_content_similarity(spark, sf_dir):
    pages = heavy_table(spark, sf_dir, "pages")
    content = H.extract(pages, ["title", "headings"]).withColumn("content", H.flat_headings())
    scored = S.url_content_similarity(content, ENCODER, threshold=0.5)
    return scored.select("page_id", F.round("similarity", 6).alias("similarity"), "match")


@query(
    " UNION ALL ".join(
        f"""SELECT '{e.name}' AS Model, url AS URL, round(similarity, 6) AS Similarity,
          similarity >= 0.8 AS "Match" FROM ({page_similarity_sql(e.dim)})"""
        for e in (ENCODER, SMALL_ENCODER)
    )
)
def compare_encoders(spark, sf_dir):
    pages = heavy_table(spark, sf_dir, "pages")
    compared = S.compare_encoders(pages, [ENCODER, SMALL_ENCODER])
    return compared.withColumn("Similarity", F.round("Similarity", 6))


@query(
    " UNION ALL ".join(
        f"""SELECT '{e.name}' AS Model, url AS URL, round(similarity, 6) AS Similarity,
          similarity >= 0.8 AS "Match" FROM ({page_similarity_sql(e.dim)})
          WHERE page_id IN (SELECT page_id FROM ({BATCH_CONTENT_SQL}))"""
        for e in (ENCODER, SMALL_ENCODER)
    )
)
def compare_encoders_of_batches(spark, sf_dir):
    """Encoders compared over the stored content of the batches 104..114."""
    pages = pages_of_batches(heavy_table(spark, sf_dir, "pages"), CONTENT_BATCHES)
    compared = S.compare_encoders(pages, [ENCODER, SMALL_ENCODER])
    return compared.withColumn("Similarity", F.round("Similarity", 6))


# ---- nearest headline ----------------------------------------------------------------

CORPUS_SQL = """
  SELECT doc_id AS idx, text, toxic AS label FROM documents JOIN labels USING (doc_id)"""


def nearest_sql(contents: str) -> str:
    """(text, sim, label, idx) of the nearest labelled document per distinct text."""
    return f"""
      SELECT text, max(sim) AS sim, arg_max(label, {{'s': sim, 'i': -idx}}) AS label,
        arg_max(idx, {{'s': sim, 'i': -idx}}) AS idx
      FROM (SELECT a.text, b.idx, b.label, {COSINE_SQL} AS sim
            FROM ({vectors_sql(contents)}) a CROSS JOIN (
              SELECT idx, label, embedding FROM ({CORPUS_SQL}) JOIN ({vectors_sql(CORPUS_SQL)}) v
              USING (text)) b)
      GROUP BY text"""


def labelled_documents(spark, sf_dir) -> DataFrame:
    """The documents with a label as headline corpus: idx, headline, clickbait."""
    documents = heavy_table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    return documents.select(
        F.col("doc_id").alias("idx"), F.col("text").alias("headline"), F.col("toxic").alias("clickbait")
    )


def document_corpus(spark, sf_dir, **bound) -> S.HeadlineCorpus:
    return S.read_corpus(labelled_documents(spark, sf_dir), ENCODER, **bound)


UNLABELLED_SQL = "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"
NEAREST_DOCUMENT_SQL = f"""
  SELECT doc_id, round(sim, 6) AS sim, label, idx
  FROM ({UNLABELLED_SQL}) LEFT JOIN ({nearest_sql(UNLABELLED_SQL)}) USING (text)"""


def _nearest_document(spark, sf_dir, **bound) -> DataFrame:
    documents = heavy_table(spark, sf_dir, "documents")
    unlabelled = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    vectors = S.embed_texts(unlabelled, "text", ENCODER).select("doc_id", "embedding")
    corpus = document_corpus(spark, sf_dir, **bound)
    found = S.nearest_headline(vectors, corpus, "doc_id")
    return found.select("doc_id", F.round("sim", 6).alias("sim"), "label", "idx")


@query(NEAREST_DOCUMENT_SQL)
def nearest_document(spark, sf_dir):
    """The most similar labelled document of every unlabelled one."""
    return _nearest_document(spark, sf_dir)


@query(NEAREST_DOCUMENT_SQL)
def nearest_document_in_blocks(spark, sf_dir):
    """The same with a broadcast bound below the corpus size, through block comparison."""
    return _nearest_document(spark, sf_dir, broadcast_bytes=64 << 10)


NEAREST_MEAN_SQL = f"""
  SELECT vec_id, own, max(sim) AS sim, CAST(arg_max(idx < 5, sim) AS INTEGER) AS label
  FROM (SELECT a.vec_id, a.label AS own, b.label AS idx, {COSINE_SQL} AS sim
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings) a CROSS JOIN
          (SELECT label, list(mean ORDER BY pos) AS embedding FROM ({MEANS_SQL}) GROUP BY label) b)
  GROUP BY vec_id, own"""


def _nearest_mean(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    means = S.mean_vector(vectors, ["label"], "embedding").select(
        F.col("label").alias("idx"),
        F.col("mean").alias("embedding"),
        (F.col("label") < 5).cast("int").alias("label"),
    )
    contents = vectors.select("vec_id", F.col("label").alias("own"), "embedding")
    return S.nearest_headline(contents, S.HeadlineCorpus(means), "vec_id")


@query(f"SELECT vec_id, round(sim, 6) AS sim, label FROM ({NEAREST_MEAN_SQL})")
def nearest_mean(spark, sf_dir):
    """The nearest label mean of every stored vector; means of labels below 5 count as clickbait."""
    found = _nearest_mean(spark, sf_dir)
    return found.select("vec_id", F.round("sim", 6).alias("sim"), "label")


@query(
    f"""SELECT own, round(avg(CAST(sim >= 0.7 AND label = 1 AS INTEGER)), 6) AS property_score
       FROM ({NEAREST_MEAN_SQL}) GROUP BY own"""
)
def clickbait_property_score(spark, sf_dir):
    """Share of clickbait vectors per label, a label's vectors standing for a page's strings."""
    scored = S.clickbait_property_score(_nearest_mean(spark, sf_dir), "own", 0.7)
    return scored.select("own", F.round("property_score", 6).alias("property_score"))


# ---- text rules ----------------------------------------------------------------------


@query(
    f"""SELECT source, round(coalesce(avg(h / (h + 1)) FILTER (WHERE h > 0), 0.0), 6) AS fear_score
       FROM (SELECT source, {hits_sql('text')} AS h FROM documents) GROUP BY source"""
)
def fear_score(spark, sf_dir):
    """Per source, the documents standing for its headings."""
    documents = table(spark, sf_dir, "documents").select(
        "source", hostile_prediction(F.col("text")).alias("p")
    )
    scored = scoring.fear_score(documents.select("source", "p.*"), "source")
    return scored.select("source", F.round("fear_score", 6).alias("fear_score"))


@query(f"SELECT doc_id, round({error_rate_sql('text')}, 6) AS grammar_error_rate FROM documents")
def grammar_error_rate(spark, sf_dir):
    scored = scoring.grammar_scores(heavy_table(spark, sf_dir, "documents"), "text")
    return scored.select("doc_id", F.round("grammar_error_rate", 6).alias("grammar_error_rate"))


@query(
    f"""SELECT page_id, round({error_rate_sql('text')}, 6) AS grammar_error_rate
       FROM (SELECT page_id, {TEXT_SQL} AS text FROM pages)"""
)
def page_grammar_error_rate(spark, sf_dir):
    text = H.clean_text(heavy_table(spark, sf_dir, "pages"), "page_id")
    scored = scoring.grammar_scores(text, "text")
    return scored.select("page_id", F.round("grammar_error_rate", 6).alias("grammar_error_rate"))


@query(
    """SELECT source, count(*) AS documents, count(*) AS scored, true AS fear_score_agrees,
         true AS above_floor FROM documents GROUP BY source"""
)
def text_classifier(spark, sf_dir):
    """A classifier trained on the labelled documents scores all documents of every source.

    scored: documents with one of the two labels and a confidence of a half to one.
    fear_score_agrees: the source's fear score is the mean confidence of its positive
    documents, counted anew. above_floor: nine in ten labelled documents are classified right.
    """
    from pagerisk.operators.training import classify_text, train_text_classifier
    from pagerisk.session import materialise

    labelled = labelled_documents(spark, sf_dir).select(
        "idx", F.col("headline").alias("text"), F.col("clickbait").alias("label")
    )
    model = train_text_classifier(labelled.drop("idx"))
    documents = heavy_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    scored = classify_text(model, documents).select("doc_id", "source", "label_name", "score")
    scored = materialise(scored, "classified-documents")
    positive = F.col("label_name") == FEAR_LABEL
    truth = labelled.select(F.col("idx").alias("doc_id"), (F.col("label") == 1).alias("truth"))
    right = F.avg((positive == F.col("truth")).cast("int")).alias("right")
    floor = scored.join(truth, "doc_id").agg(right).first()["right"]
    known = F.col("label_name").isin(FEAR_LABEL, NO_FEAR_LABEL) & F.col("score").between(0.5, 1)
    counted = scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(known).alias("scored"),
        F.coalesce(F.avg(F.when(positive, F.col("score"))), F.lit(0.0)).alias("__mean"),
    )
    found = scoring.fear_score(
        scored.select("source", F.col("label_name").alias("label"), "score"), "source"
    )
    agrees = F.abs(F.col("fear_score") - F.col("__mean")) < 1e-9
    return counted.join(found, "source").select(
        "source", "documents", "scored", agrees.alias("fear_score_agrees"),
        F.lit(floor >= 0.9).alias("above_floor"),
    )
