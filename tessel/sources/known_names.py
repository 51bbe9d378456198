"""The bundled list of invented package names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.names import list_key

# The listed names with their ecosystem, tier and the day on which they were recorded.
ROWS = [
    ("flask-gpt", "pypi", "pattern", "2026-06-01"),
    ("flask-gpt4", "pypi", "pattern", "2026-06-01"),
    ("flask-chatgpt", "pypi", "pattern", "2026-06-01"),
    ("django-gpt", "pypi", "pattern", "2026-06-01"),
    ("django-ai", "pypi", "pattern", "2026-06-01"),
    ("django-llm", "pypi", "pattern", "2026-06-01"),
    ("fastapi-gpt", "pypi", "pattern", "2026-06-01"),
    ("fastapi-chatgpt", "pypi", "pattern", "2026-06-01"),
    ("express-gpt", "npm", "pattern", "2026-06-01"),
    ("express-ai", "npm", "pattern", "2026-06-01"),
    ("react-gpt", "npm", "pattern", "2026-06-01"),
    ("react-ai-helper", "npm", "pattern", "2026-06-01"),
    ("vue-gpt", "npm", "pattern", "2026-06-01"),
    ("next-gpt", "npm", "pattern", "2026-06-01"),
    ("next-ai", "npm", "pattern", "2026-06-01"),
    ("prisma-gpt", "npm", "pattern", "2026-06-01"),
    ("langchain-gpt", "pypi", "pattern", "2026-06-01"),
    ("langchain-gpt4", "pypi", "pattern", "2026-06-01"),
    ("openai-utils", "pypi", "pattern", "2026-06-01"),
    ("gpt-utils", "pypi", "pattern", "2026-06-01"),
    ("gpt-helper", "npm", "pattern", "2026-06-01"),
    ("ai-utils", "npm", "pattern", "2026-06-01"),
    ("llm-utils", "npm", "pattern", "2026-06-01"),
    ("llm-helper", "pypi", "pattern", "2026-06-01"),
    ("chatgpt-helper", "npm", "pattern", "2026-06-01"),
    ("chatgpt-utils", "pypi", "pattern", "2026-06-01"),
    ("mongoose-gpt", "npm", "pattern", "2026-06-01"),
    ("sequelize-ai", "npm", "pattern", "2026-06-01"),
    ("drizzle-ai", "npm", "pattern", "2026-06-01"),
    ("axios-ai", "npm", "pattern", "2026-06-01"),
    ("pandas-gpt", "pypi", "pattern", "2026-06-01"),
    ("numpy-gpt", "pypi", "pattern", "2026-06-01"),
    ("pytorch-gpt", "pypi", "pattern", "2026-06-01"),
    ("tensorflow-gpt", "pypi", "pattern", "2026-06-01"),
    ("sklearn-gpt", "pypi", "pattern", "2026-06-01"),
    ("react-codeshift", "npm", "reported", "2026-04-19"),
    ("unused-imports", "npm", "reported", "2026-04-19"),
    ("huggingface-cli", "pypi", "reported", "2026-04-19"),
]


def known_names(spark: SparkSession) -> DataFrame:
    """``name``, ``ecosystem``, ``tier`` (reported, pattern, observed, community) and ``recorded`` (a day)."""
    return spark.createDataFrame(ROWS, "name string, ecosystem string, tier string, recorded string")


def with_known(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``refs`` with ``tier`` and ``recorded`` of the listed name, null for others.

    Names are compared in lower case; crates don't tell ``_`` from ``-``.  Of a name listed twice the first
    recorded row counts.  The list is small and Spark broadcasts it by its size.
    """
    side = known.select(list_key(F.col("name"), F.col("ecosystem")).alias("_key"), "tier", "recorded")
    side = side.groupBy("_key").agg(F.min_by(F.struct("tier", "recorded"), F.struct("recorded", "tier")).alias("_x")).select("_key", F.col("_x.tier").alias("tier"), F.col("_x.recorded").alias("recorded"))
    return refs.withColumn("_key", list_key(F.col("pkg"), F.col("ecosystem"))).join(side, "_key", "left").drop("_key")
