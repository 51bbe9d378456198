"""The whole check: files, registry answers and the list of invented names to a result for each scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators.classify import FINDING, manifest_errors, package_findings, secret_rows
from tessel.operators.refs import package_refs
from tessel.operators.secrets import secret_findings
from tessel.operators.verdict import distinct_findings, results
from tessel.sources.known_names import known_names, with_known
from tessel.sources.registry import parse_answers, with_registry


def findings(files: DataFrame, answers: DataFrame, as_of: str, known: DataFrame | None = None) -> DataFrame:
    """All findings of all scans, each once."""
    known = known_names(files.sparkSession) if known is None else known
    refs, errors = package_refs(files)
    refs = with_registry(with_known(refs, known), parse_answers(answers, as_of))
    parts = manifest_errors(errors).select(FINDING).unionByName(package_findings(refs, as_of).select(FINDING)).unionByName(secret_rows(secret_findings(files)).select(FINDING))
    return distinct_findings(parts)


def scans(files: DataFrame) -> DataFrame:
    return files.groupBy("scan_id").agg(F.count("*").alias("files_checked"))


def preflight(files: DataFrame, answers: DataFrame, as_of: str, known: DataFrame | None = None) -> DataFrame:
    """One row for each scan: verdict, counts, action and the listed findings."""
    return results(scans(files), findings(files, answers, as_of, known))
