"""The service as a stream: JSON lines in, one reply for each line that asks for one out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessel.operators.verdict import as_json, results
from tessel.plans.preflight import findings, scans
from tessel.sources.requests import INVALID_PARAMS, check_calls, parse_messages, report_calls, report_outcome
from tessel.streaming.protocol import failed, replies, succeeded, tool_result

#: Files of requests that a batch takes, at most: the rest waits.
MAX_FILES_A_TRIGGER = 4
#: Answers of the list that takes reports.
FEED = "package string, ecosystem string, status string, name string, reason string, http int"
NO_FEED = "The report did not reach the list; nothing was stored."


def read_requests(spark: SparkSession, folder: str, most: int = MAX_FILES_A_TRIGGER) -> DataFrame:
    """A stream of lines from text files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", most).text(folder)


def check_replies(messages: DataFrame, answers: DataFrame, as_of: str) -> DataFrame:
    """Replies (``line``, ``batch``, ``at``, ``reply``) to the calls of the checking tool."""
    files, calls = check_calls(messages)
    checked = as_json(results(scans(files).join(calls.select(F.col("call").alias("scan_id"), "context"), "scan_id", "left"), findings(files, answers, as_of)))
    both = calls.join(checked.withColumnRenamed("scan_id", "call"), "call", "left")
    reply = F.when(F.col("error").isNotNull(), failed(F.col("id"), INVALID_PARAMS, F.col("error"))).otherwise(succeeded(F.col("id"), tool_result(F.col("result"))))
    return both.select("line", "batch", "at", reply.alias("reply"))


def report_replies(messages: DataFrame, feed: DataFrame | None = None) -> DataFrame:
    """Replies to the calls of the reporting tool.

    ``feed`` has the list's answers (``FEED``), one for each name: the engine makes no requests, so a name without
    one did not reach the list.
    """
    calls = report_calls(messages)
    feed = messages.sparkSession.createDataFrame([], FEED) if feed is None else feed
    both = calls.join(feed.dropDuplicates(["ecosystem", "package"]), ["ecosystem", "package"], "left")
    reached = F.col("http").isNotNull()
    text = F.when(reached, report_outcome(F.col("status"), F.col("name"), F.col("reason"), F.col("http"))).otherwise(F.lit(NO_FEED))
    reply = F.when(F.col("error").isNotNull(), failed(F.col("id"), INVALID_PARAMS, F.col("error"))).otherwise(succeeded(F.col("id"), tool_result(text, ~reached)))
    return both.select("line", "batch", "at", reply.alias("reply"))


def respond(lines: DataFrame, answers: DataFrame, as_of: str, feed: DataFrame | None = None) -> DataFrame:
    """``line`` and ``reply`` (JSON text) for each line that gets one.

    A line is a message or an array of them.  Every message with a method that isn't a notification gets one reply,
    whatever is wrong with it; the replies to an array are an array in its order.  Notifications, arrays of them
    alone and blank lines get none; a line that isn't JSON gets the parse error.
    """
    messages, bad = parse_messages(lines)
    plain = replies(messages).select("line", "batch", "at", "reply").filter("reply IS NOT NULL")
    each = plain.unionByName(check_replies(messages, answers, as_of)).unionByName(report_replies(messages, feed))
    # an empty array is answered by one error, not by an array
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "reply"))), lambda x: x["reply"]), ","), F.lit("]"))
    whole = each.groupBy("line").agg(F.when(F.first("batch") & (F.min("at") >= 0), listed).otherwise(F.min("reply")).alias("reply"))
    return whole.unionByName(bad.select("line", failed(F.lit(None).cast("string"), -32700, F.lit("Parse error")).alias("reply")))


def valid_reports(lines: DataFrame) -> DataFrame:
    """``package``, ``ecosystem`` and ``reporter`` of the valid reports among the messages of the lines."""
    return report_calls(parse_messages(lines)[0]).filter("error IS NULL").select("package", "ecosystem", "reporter")


def serve(requests: DataFrame, answers: DataFrame, as_of: str, replies_path: str, checkpoint: str, feed: DataFrame | None = None, reports_path: str | None = None) -> StreamingQuery:
    """Answers a stream of lines into a folder of Parquet, and stores the valid reports in another if one is given.

    Each batch writes to a folder named by its number, over what a failed try of the same batch left, so every
    line is answered once.  Replies have no order; clients find them by the ids of their messages.
    """

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line", F.monotonically_increasing_id())
        respond(lines, answers, as_of, feed).write.mode("overwrite").parquet(f"{replies_path}/batch={number}")
        if reports_path:
            valid_reports(lines).write.mode("overwrite").parquet(f"{reports_path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_reports(reports: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of valid reports (``validate_reports``) to a table, each batch once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.filter("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
