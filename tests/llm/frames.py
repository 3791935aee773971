"""Awkward tables that every operator must take."""

DOCUMENTS = "doc_id long, text string, lang string, source string"
CLASH = [
    "kept", "node", "queue", "key", "size", "n_words", "d", "h", "_block", "words", "ids",
    "n_lines", "taken", "score", "component_id", "held_out",
]

LONG = " ".join(f"word{n % 977} thing{n % 613}" for n in range(30_000))


def rows():
    prose = "the cat of the house sat on a mat and it was warm in the sun for a while"
    return [
        (1, prose, "en", "a"),
        (2, prose, "en", "a"),
        (2, prose, "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \t\n \x0b", "fr", "b"),
        (6, "one", None, None),
        (7, "le chat de la maison est sur le tapis et il fait chaud dans la rue", "fr", "c"),
        (None, "no id here but some words of a text that is long enough to be read", "en", "c"),
        (None, None, None, None),
        (8, LONG, "en", "b"),
        (8, "another text under the same id", "en", "b"),
        (9, "12 34 !! ***", "en", "a"),
        (10, "line one of the text is this\n\nline one of the text is this\nend", "en", "a"),
        (-(2**63), "the lowest id of all", "en", "a"),
        (11, "é̂ Ünïcode ŉ İstanbul ΑΣ 𝒳 \U0003fc3b end", "fr", "a"),
    ]


def awkward(spark, clash=True):
    frame = spark.createDataFrame(rows(), DOCUMENTS).repartition(3, "source")
    if clash:
        from pyspark.sql import functions as F

        for name in CLASH:
            frame = frame.withColumn(name, F.lit("x"))
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
