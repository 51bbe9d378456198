"""A scan's package references from both sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.evidence import apply_evidence, internal_evidence
from tessel.operators.imports import import_refs
from tessel.operators.manifests import manifest_refs

#: Lookups of a scan; the references beyond are reported as unverified, never dropped.
MAX_LOOKUPS = 1000


def merged(refs: DataFrame) -> DataFrame:
    """Of references with ``source`` one for each (scan, ecosystem, package): an import goes before a manifest, the
    earliest before others.

    With ``ord``, the reference's place in its scan: imports first, in the order of the files.
    """
    both = refs.withColumn("_source", F.when(F.col("source") == "import", 0).otherwise(1))
    by = Window.partitionBy("scan_id", "ecosystem", "pkg").orderBy("_source", "file_ord", "line", "seg")
    first = both.withColumn("_rank", F.row_number().over(by)).filter("_rank = 1").drop("_rank")
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("scan_id").orderBy("_source", "file_ord", "line", "seg", "ecosystem", "pkg"))).drop("_source")


def with_budget(refs: DataFrame, most: int = MAX_LOOKUPS) -> DataFrame:
    """``refs`` with ``looked_up``: whether the reference is within its scan's budget."""
    return refs.withColumn("looked_up", F.col("ord") <= most)


def package_refs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references of each scan, without the project's own names, and the manifests that can't be read."""
    evidence = internal_evidence(files)
    manifests, errors = manifest_refs(files)
    both = import_refs(files).withColumn("source", F.lit("import")).unionByName(manifests.withColumn("source", F.lit("manifest")))
    return with_budget(merged(apply_evidence(both, evidence))), errors
