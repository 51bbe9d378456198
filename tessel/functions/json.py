"""JSON as variants, read to the letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import held


def last_key_counts(spark: SparkSession) -> None:
    """Of repeated keys of an object the last one counts, as where JSON is read into objects.

    That is a setting of the session (``spark.sql.variant.allowDuplicateKeys``), which this sets.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(content: Column) -> Column:
    """The content as a variant, or null if it isn't JSON to the letter.

    ``try_parse_json`` alone lets text follow the value; inside an object and inside an array it can't.
    """
    inside_ = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), content, F.lit(',"__z":0}'))), "$.__z", "int") == 0
    alone = F.size(F.try_parse_json(F.concat(F.lit("["), content, F.lit("]"))).try_cast("array<variant>")) == 1
    return F.when(F.coalesce(inside_, F.lit(False)) & F.coalesce(alone, F.lit(False)), F.try_parse_json(content))


def parsed(files: DataFrame, where: Column | None = None) -> DataFrame:
    """``files`` with ``_json``, null where ``where`` doesn't hold.

    Of repeated keys the last one counts (``last_key_counts``).
    """
    last_key_counts(files.sparkSession)
    value = strict_json(F.col("content"))
    return held(files, "_json", value if where is None else F.when(where, value))


def kind_of(value: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``VOID`` (JSON's null) or the type of another scalar; null for no value."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def text_value(value: Column) -> Column:
    """A variant's string; null for other kinds."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
