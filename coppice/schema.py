"""Names and types of the evidence model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_TYPES = ("text_sentence", "table_cell", "caption", "ocr_text", "web_snippet", "web_page_text")
WEB_TYPES = ("web_snippet", "web_page_text")
SUPPORTS, CONTRADICTS, UNCERTAIN = "supports", "contradicts", "uncertain"

UNIT = T.StructType([
    T.StructField("unit_ix", T.LongType(), False),
    T.StructField("doc_id", T.StringType(), False),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("content", T.StringType(), False),
    T.StructField("section_path", T.StringType()),
    T.StructField("char_start", T.LongType()),
    T.StructField("char_end", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("canonical_entity_id", T.StringType()),
])


def citation_id() -> Column:
    return F.concat(F.col("doc_id"), F.lit(":"), F.coalesce("section_path", F.lit("")), F.lit(":"), F.col("char_start"), F.lit("-"), F.col("char_end"))
