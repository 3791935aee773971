"""Explicit schemas of the stored and exchanged tables."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

PAGE_SCALARS = ("html", "title")
PAGE_LISTS = ("embedded_scripts", "external_scripts", "links", "headers")
PAGE_FIELDS = ("html", "embedded_scripts", "external_scripts", "title", "links", "headers")

WEBPAGE = T.StructType(
    [
        T.StructField("url", T.StringType(), False),
        T.StructField("html", T.StringType()),
        T.StructField("embedded_scripts", _STRINGS),
        T.StructField("external_scripts", _STRINGS),
        T.StructField("title", T.StringType()),
        T.StructField("links", _STRINGS),
        T.StructField("headers", _STRINGS),
    ]
)

# A page row as it lands from extraction: where it was found, then its fields.
LANDED = T.StructType(
    [T.StructField("file_idx", T.LongType()), T.StructField("record_no", T.LongType())]
    + list(WEBPAGE.fields)
)

RAW_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("file_idx", T.LongType()),
        T.StructField("record_no", T.LongType()),
        T.StructField("rec_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("http_content_type", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

INGEST_STATE = T.StructType(
    [
        T.StructField("last_batch_id", T.IntegerType()),
        T.StructField("last_item_index", T.IntegerType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

HEADLINE = T.StructType(
    [T.StructField("headline", T.StringType()), T.StructField("clickbait", T.IntegerType())]
)

THREAT_RESPONSE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField(
            "matches",
            T.ArrayType(T.StructType([T.StructField("threatType", T.StringType())])),
        ),
        T.StructField("error", T.StringType()),
    ]
)

WAT_ENVELOPE = T.StructType(
    [
        T.StructField(
            "Envelope",
            T.StructType(
                [
                    T.StructField(
                        "WARC-Header-Metadata",
                        T.StructType([T.StructField("WARC-Target-URI", T.StringType())]),
                    ),
                    T.StructField(
                        "Payload-Metadata",
                        T.StructType(
                            [
                                T.StructField(
                                    "HTTP-Response-Metadata",
                                    T.StructType(
                                        [
                                            T.StructField(
                                                "HTML-Metadata",
                                                T.StructType(
                                                    [
                                                        T.StructField(
                                                            "Head",
                                                            T.StructType(
                                                                [T.StructField("Title", T.StringType())]
                                                            ),
                                                        ),
                                                        T.StructField(
                                                            "Links",
                                                            T.ArrayType(
                                                                T.StructType(
                                                                    [T.StructField("url", T.StringType())]
                                                                )
                                                            ),
                                                        ),
                                                    ]
                                                ),
                                            ),
                                            T.StructField(
                                                "HTML",
                                                T.StructType([T.StructField("Content", T.StringType())]),
                                            ),
                                        ]
                                    ),
                                )
                            ]
                        ),
                    ),
                ]
            ),
        )
    ]
)
