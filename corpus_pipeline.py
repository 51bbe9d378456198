"""The corpus pipeline: documents through the stages of STAGES, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import WRITTEN, clean, table, written
from tessel.llm.drr_packing import pack
from tessel.llm.golomb_dedup import without_copies
from tessel.llm.lang_mixture import fit, held_out, with_main_language
from tessel.llm.odd_sketches import without_near_copies
from tessel.llm.suffix_automata import remove_repeats

#: A document is rejected if no language has this share of its words.
MAIN_SHARE = 0.4
#: Words of a passage that is taken out where it is repeated.
PASSAGE = 50
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the models are learned from the documents' own labels."""
    return with_main_language(docs, fit(docs, ~held_out()), MAIN_SHARE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: shingles of five words, similarity 0.8."""
    return without_near_copies(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; ``n_chars`` follows a text that changes."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    got = remove_repeats(docs, PASSAGE, carry=others)
    if "n_chars" in others:
        got = got.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids packed into sequences, mixed by source."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: SQL can't express EM, MinHash or the tokenizer; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the table ``documents``.

    Once a stage's table is written, what it and the stage before wrote on the way is deleted.
    """
    docs, before = table(spark, sf_dir, "documents"), len(WRITTEN)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            clean(spark, before, keep=(WRITTEN[-1],))
    return docs
