"""Row types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DateType()
_LIST = T.ArrayType(_S)
_FREE = T.MapType(_S, T.VariantType())

# name -> (type, kind of JSON value taken, required)
ARTICLE_FIELDS: list[tuple[str, T.DataType, str, bool]] = [
    ("document_id", _S, "string", True),
    ("text", _S, "string", True),
    ("title", _S, "string", False),
    ("excerpt", _S, "string", False),
    ("author", _S, "string", False),
    ("publication_date", _D, "date", False),
    ("revision_date", _D, "date", False),
    ("source_url", _S, "url", False),
    ("categories", _LIST, "strings", False),
    ("tags", _LIST, "strings", False),
    ("media_asset_urls", _LIST, "urls", False),
    ("geographical_data", _FREE, "object", False),
    ("embargo_date", _D, "date", False),
    ("sentiment", _S, "string", False),
    ("word_count", _L, "integer", False),
    ("publisher", _S, "string", False),
    ("additional_metadata", _FREE, "object", False),
]

ARTICLE = T.StructType([T.StructField(n, t, not req) for n, t, _, req in ARTICLE_FIELDS])

ENTITY = T.StructType(
    [
        T.StructField("text", _S),
        T.StructField("type", _S),
        T.StructField("start_char", _L),
        T.StructField("end_char", _L),
    ]
)
ENTITIES = T.ArrayType(ENTITY)

# Columns of a processed row, in order.
PROCESSED_COLUMNS = [
    "document_id",
    "version",
    "original_text",
    "cleaned_text",
    "cleaned_title",
    "cleaned_excerpt",
    "cleaned_author",
    "cleaned_publication_date",
    "cleaned_revision_date",
    "cleaned_source_url",
    "cleaned_categories",
    "cleaned_tags",
    "cleaned_media_asset_urls",
    "cleaned_geographical_data",
    "cleaned_embargo_date",
    "cleaned_sentiment",
    "cleaned_word_count",
    "cleaned_publisher",
    "temporal_metadata",
    "entities",
    "cleaned_additional_metadata",
]

LEDGER = T.StructType(
    [
        T.StructField("job_id", _S, False),
        T.StructField("ledger_seq", _L, False),
        T.StructField("at", T.TimestampType(), False),
        T.StructField("batch_id", _S),
        T.StructField("status", _S),
        T.StructField("total_documents", _L),
        T.StructField("processed_documents", _L),
        T.StructField("failed_documents", _L),
        T.StructField("error_message", _S),
        T.StructField("metadata", T.MapType(_S, _S)),
        T.StructField("statistics", T.MapType(_S, _S)),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("specversion", _S, False),
        T.StructField("type", _S, False),
        T.StructField("source", _S, False),
        T.StructField("id", _S, False),
        T.StructField("time", _S),
        T.StructField("subject", _S),
        T.StructField("datacontenttype", _S, False),
        T.StructField("data", T.MapType(_S, _S)),
    ]
)
