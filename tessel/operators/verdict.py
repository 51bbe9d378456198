"""From findings to one verdict for each scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Findings that a result lists; the verdict uses all.
MAX_LISTED = 20
LISTED = ["severity", "type", "title", "file", "line", "description", "recommendation", "cve"]


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Of findings with the same scan, file, line, type and title the first, by ``rank`` and ``ord``."""
    by = Window.partitionBy("scan_id", "file", "line", "type", "title").orderBy("rank", "ord", "description")
    return findings.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def verdict(critical: Column, warnings: Column) -> Column:
    return F.when(critical > 0, "BLOCKED").when(warnings > 0, "REVIEW_REQUIRED").otherwise("CLEAR")


def action(verdict: Column) -> Column:
    return F.when(verdict == "BLOCKED", "Do not commit; mend the critical findings first.").when(verdict == "REVIEW_REQUIRED", "Review the warnings before committing.").otherwise("No issue found.")


def summary(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """``scan_id``, ``files_checked``, ``critical``, ``warnings`` and ``verdict`` of every scan, CLEAR without a finding.

    ``scans`` has ``scan_id`` and ``files_checked``.
    """
    counts = findings.groupBy("scan_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    both = scans.join(counts, "scan_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("critical", "warnings")})
    return both.withColumn("verdict", verdict(F.col("critical"), F.col("warnings")))


def listed(findings: DataFrame, most: int = MAX_LISTED) -> DataFrame:
    """The first findings of each scan, critical ones before the others, otherwise in their order; with ``place``."""
    by = Window.partitionBy("scan_id").orderBy((F.col("severity") == "critical").desc(), "rank", "ord", "file", "line", "type", "title")
    return findings.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most)


def results(scans: DataFrame, findings: DataFrame, most: int = MAX_LISTED) -> DataFrame:
    """One row for each scan: the summary, the action and ``findings``, an array in the order of the listing."""
    rows = listed(findings, most).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("place", *LISTED))).alias("_list"))
    empty = "array<struct<severity:string,type:string,title:string,file:string,line:int,description:string,recommendation:string,cve:string>>"
    out = summary(scans, findings).join(rows, "scan_id", "left").withColumn("action", action(F.col("verdict")))
    pick = F.transform("_list", lambda x: F.struct(*[x[c].alias(c) for c in LISTED])).cast(empty)
    return out.withColumn("findings", F.coalesce(pick, F.array().cast(empty))).drop("_list")


def as_json(results: DataFrame) -> DataFrame:
    """``scan_id`` and the result as JSON text: verdict, summary, findings and action.

    The summary has the call's context, null without one.  A finding without a ``cve`` has no such key.
    """
    context = F.col("context") if "context" in results.columns else F.lit(None).cast("string")
    total = F.struct(F.col("files_checked").alias("filesChecked"), "critical", "warnings", context.alias("context"))
    text = F.concat(
        F.lit('{"verdict":"'), F.col("verdict"), F.lit('","summary":'), F.to_json(total, {"ignoreNullFields": "false"}), F.lit(',"findings":'), F.to_json("findings", {"ignoreNullFields": "true"}),
        F.lit(',"action":"'), F.col("action"), F.lit('"}'),
    )
    return results.select("scan_id", text.alias("result"))
