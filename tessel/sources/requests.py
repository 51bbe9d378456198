"""Requests of the scanning service: files to check, reports of invented names, JSON lines and calls in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.json import kind_of, last_key_counts, strict_json, text_value
from tessel.functions.text import held, trimmed

# The bounds of a call.
MAX_FILES, MAX_PATH, MAX_CONTENT, MAX_CONTEXT, MAX_PACKAGE = 50, 1_024, 200_000, 500, 214
REPORTER = (2, 30)
REPORTABLE = ("npm", "pypi", "crates", "gems")
PARSE_ERROR, INVALID_PARAMS = -32700, -32602
#: The tools: one checks files, one takes reports of invented names.
CHECK, REPORT = "pre_flight_check", "report_hallucination"


def string_error(value: Column, field: Column | str, least: int, most: int, optional: bool = False) -> Column:
    """Why a string isn't one of ``least`` to ``most`` characters, or null."""
    field = F.lit(field) if isinstance(field, str) else field
    missing = F.lit(None).cast("string") if optional else F.concat(field, F.lit(" must be a string"))
    n = F.char_length(value)
    return F.when(value.isNull(), missing).when(n < least, F.concat(field, F.lit(f" must have at least {least} characters"))).when(n > most, F.concat(field, F.lit(f" must have at most {most} characters")))


def validate_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of valid scans, and one row (``scan_id``, ``error``) for each scan that is refused.

    A scan has 1 to MAX_FILES files; the first file with a bad path or content gives the reason.  Files have
    ``scan_id``, ``file_ord`` from 0, ``path`` and ``content``.
    """
    name = F.concat(F.lit("files["), F.col("file_ord").cast("string"), F.lit("]"))
    own = F.coalesce(string_error(F.col("path"), F.concat(name, F.lit(".path")), 1, MAX_PATH), string_error(F.col("content"), F.concat(name, F.lit(".content")), 0, MAX_CONTENT))
    each = files.withColumn("_error", own)
    scans = each.groupBy("scan_id").agg(F.count("*").alias("_n"), F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("file_ord"))).alias("_first"))
    errors = scans.select("scan_id", F.when(F.col("_n") > MAX_FILES, F.lit(f"files must have at most {MAX_FILES} entries")).otherwise(F.col("_first")).alias("error")).filter("error IS NOT NULL")
    return files.join(errors, "scan_id", "left_anti"), errors


def validate_reports(reports: DataFrame) -> DataFrame:
    """``reports`` (``package``, ``ecosystem``, ``reporter``) with ``error``, null for a valid one."""
    eco = F.when(F.coalesce(F.col("ecosystem").isin(*REPORTABLE), F.lit(False)), F.lit(None)).otherwise(F.lit("ecosystem must be one of: " + ", ".join(REPORTABLE)))
    return reports.withColumn("error", F.coalesce(eco, string_error(F.col("package"), "package", 1, MAX_PACKAGE), string_error(F.col("reporter"), "reporter", *REPORTER, optional=True)))


def report_outcome(status: Column, name: Column, reason: Column, http: Column) -> Column:
    """What the reporter is told."""
    return (
        F.when(status == "accepted", F.concat(F.lit("Reported: "), F.coalesce(name, F.lit("the name")), F.lit(" is on the list now.")))
        .when(status == "duplicate", F.lit("The name is on the list already."))
        .when(status == "rejected", F.concat(F.lit("Not accepted: "), F.coalesce(reason, F.lit("the report was rejected")), F.lit(".")))
        .when(status == "unverifiable", F.concat(F.lit("Could not verify: "), F.coalesce(reason, F.lit("the registry was not reached")), F.lit("; nothing was stored.")))
        .otherwise(F.concat(F.lit("Unexpected answer (HTTP "), http.cast("string"), F.lit("); nothing was stored.")))
    )


def parse_messages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON lines (``value``) as messages, and the lines that aren't JSON (``line``, ``value``, ``code``).

    A message has ``line`` (the line's number, from ``lines`` if it has that column), ``batch`` (whether the line is
    an array) and ``at`` (its place there), ``id`` and ``params`` as JSON text and ``method``, null if it isn't a
    string.  An array is as many messages as it has elements; an empty one is one message without anything.
    Blank lines are skipped.
    """
    last_key_counts(lines.sparkSession)
    rows = lines if "line" in lines.columns else lines.withColumn("line", F.monotonically_increasing_id())
    rows = rows.withColumn("value", trimmed(F.col("value"))).filter("value <> ''").withColumn("_v", strict_json(F.col("value")))
    bad = rows.filter("_v IS NULL").select("line", "value", F.lit(PARSE_ERROR).alias("code"))
    batch = F.try_variant_get("_v", "$", "array<variant>")
    each = rows.filter("_v IS NOT NULL").select("line", batch.isNotNull().alias("batch"), F.posexplode_outer(F.coalesce(batch, F.array("_v"))).alias("at", "_m"))
    part = lambda path: F.try_variant_get("_m", path, "variant")
    return each.select("line", "batch", F.coalesce("at", F.lit(-1)).alias("at"), F.to_json(part("$.id")).alias("id"), text_value(part("$.method")).alias("method"), F.to_json(part("$.params")).alias("params")), bad


def calls_of(messages: DataFrame, tool: str) -> DataFrame:
    """The calls of a tool: messages with ``call`` (a text that tells them apart) and ``_args``, their arguments."""
    name = text_value(F.try_variant_get(F.try_parse_json("params"), "$.name", "variant"))
    calls = messages.filter((F.col("method") == "tools/call") & (name == tool))
    return calls.withColumn("call", F.concat_ws("/", "line", "at")).withColumn("_args", F.try_variant_get(F.try_parse_json("params"), "$.arguments", "variant"))


def _no_object(args: Column) -> Column:
    return F.when(~F.coalesce(kind_of(args) == "OBJECT", F.lit(False)), F.lit("arguments must be an object"))


def _text_error(value: Column, field: Column | str, least: int, most: int, optional: bool = False) -> Column:
    """``string_error`` of a variant: what isn't a string is refused, null and nothing only where it is asked for."""
    field = F.lit(field) if isinstance(field, str) else field
    bad = F.concat(field, F.lit(" must be a string"))
    none = F.coalesce(kind_of(value) == "VOID", F.lit(True))
    text = text_value(value)
    wrong = F.when(none, F.lit(None) if optional else bad).when(text.isNull(), bad)
    return F.coalesce(wrong, string_error(text, field, least, most, optional=True))


def check_calls(messages: DataFrame, tool: str = CHECK) -> tuple[DataFrame, DataFrame]:
    """Files (``scan_id`` is the call) of the valid calls of the checking tool, and of every call ``call``, ``id``,
    ``context`` and ``error`` (null for a valid one).

    Arguments are an object with ``files``, an array of 1 to MAX_FILES objects with a path and a content, and a
    context if there is one; the first thing that is wrong gives the error.
    """
    calls = calls_of(messages, tool)
    part = lambda v, path: F.try_variant_get(v, path, "variant")
    args = F.col("_args")
    calls = calls.withColumns({"_files": F.try_variant_get(args, "$.files", "array<variant>"), "_context": part(args, "$.context")})

    def of_file(f: Column, i: Column) -> Column:
        at = F.concat(F.lit("files["), i.cast("string"), F.lit("]"))
        good = F.coalesce(kind_of(f).isin("OBJECT", "ARRAY"), F.lit(False))
        return F.coalesce(
            F.when(~good, F.concat(at, F.lit(" must be an object"))), _text_error(part(f, "$.path"), F.concat(at, F.lit(".path")), 1, MAX_PATH),
            _text_error(part(f, "$.content"), F.concat(at, F.lit(".content")), 0, MAX_CONTENT),
        )

    n = F.size("_files")
    several = F.when(F.col("_files").isNull(), F.lit("files must be an array")).when(n < 1, F.lit("files must have at least 1 entry")).when(n > MAX_FILES, F.lit(f"files must have at most {MAX_FILES} entries"))
    first = F.get(F.filter(F.transform("_files", of_file), lambda e: e.isNotNull()), F.lit(0))
    error = F.coalesce(_no_object(args), several, first, _text_error(F.col("_context"), "context", 0, MAX_CONTEXT, optional=True))
    calls = held(calls, "error", error)
    files = calls.filter("error IS NULL").select(F.col("call").alias("scan_id"), F.posexplode("_files").alias("file_ord", "_f"))
    files = files.select("scan_id", "file_ord", text_value(part(F.col("_f"), "$.path")).alias("path"), text_value(part(F.col("_f"), "$.content")).alias("content"))
    return files, calls.select("line", "batch", "at", "call", "id", text_value(F.col("_context")).alias("context"), "error")


def report_calls(messages: DataFrame, tool: str = REPORT) -> DataFrame:
    """Of every call of the reporting tool ``call``, ``id``, ``package``, ``ecosystem``, ``reporter`` and ``error``."""
    part = lambda path: F.try_variant_get("_args", path, "variant")
    calls = calls_of(messages, tool)
    eco = F.when(~F.coalesce(text_value(part("$.ecosystem")).isin(*REPORTABLE), F.lit(False)), F.lit("ecosystem must be one of: " + ", ".join(REPORTABLE)))
    error = F.coalesce(_no_object(F.col("_args")), eco, _text_error(part("$.package"), "package", 1, MAX_PACKAGE), _text_error(part("$.reporter"), "reporter", *REPORTER, optional=True))
    return calls.select("line", "batch", "at", "call", "id", *(text_value(part(f"$.{x}")).alias(x) for x in ("package", "ecosystem", "reporter")), error.alias("error"))
