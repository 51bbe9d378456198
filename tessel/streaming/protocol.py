"""Replies of the JSON-RPC edge to all messages but calls of tools, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.json import text_value
from tessel.sources.requests import CHECK, REPORT

# Protocol versions, latest first, and error codes.
VERSIONS = ("2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05", "2024-10-07")
INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS, INTERNAL_ERROR = -32600, -32601, -32602, -32603

TOOLS = {
    CHECK: {"description": "Checks files for risky packages and secrets.", "inputSchema": {"type": "object", "required": ["files"], "properties": {"files": {"type": "array", "minItems": 1, "maxItems": 50}, "context": {"type": "string", "maxLength": 500}}}},
    REPORT: {"description": "Reports an invented package name.", "inputSchema": {"type": "object", "required": ["package", "ecosystem"], "properties": {"package": {"type": "string"}, "ecosystem": {"type": "string"}, "reporter": {"type": "string"}}}},
}


def _reply(id_: Column, part: str, value: Column) -> Column:
    return F.concat(F.lit('{"jsonrpc":"2.0","id":'), F.coalesce(id_, F.lit("null")), F.lit(f',"{part}":'), value, F.lit("}"))


def succeeded(id_: Column, result: Column) -> Column:
    """A reply with a result that is JSON text."""
    return _reply(id_, "result", result)


def failed(id_: Column, code: int, message: Column) -> Column:
    return _reply(id_, "error", F.to_json(F.struct(F.lit(code).alias("code"), message.alias("message"))))


def replies(messages: DataFrame, name: str = "tessel", version: str = "1") -> DataFrame:
    """``messages`` (``id``, ``method``, ``params``; see ``parse_messages``) with ``reply``.

    Notifications have none, and calls of a known tool get theirs from the tool.
    """
    id_, method, params = F.col("id"), F.col("method"), F.try_parse_json("params")
    asked, tool = (text_value(F.try_variant_get(params, f"$.{x}", "variant")) for x in ("protocolVersion", "name"))
    empty = F.col("batch") & (F.col("at") < 0) if "batch" in messages.columns else F.lit(False)
    agreed = F.when(asked.isin(*VERSIONS), asked).otherwise(F.lit(VERSIONS[0]))
    hello = F.concat(F.lit('{"protocolVersion":"'), agreed, F.lit('","capabilities":{"tools":{}},"serverInfo":' + json.dumps({"name": name, "version": version}) + "}"))
    listing = F.lit(json.dumps({"tools": [{"name": n} | t for n, t in TOOLS.items()]}))
    unknown = failed(id_, INVALID_PARAMS, F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit("none"))))
    reply = (
        F.when(empty, failed(id_, INVALID_REQUEST, F.lit("Empty batch"))).when(method.isNull(), failed(id_, INVALID_REQUEST, F.lit("A message needs a method"))).when(method.startswith("notifications/"), F.lit(None)).when(method == "initialize", succeeded(id_, hello)).when(method == "ping", succeeded(id_, F.lit("{}")))
        .when(method == "tools/list", succeeded(id_, listing)).when((method == "tools/call") & ~F.coalesce(tool.isin(*TOOLS), F.lit(False)), unknown).when(method == "tools/call", F.lit(None))
        .otherwise(failed(id_, METHOD_NOT_FOUND, F.concat(F.lit("No such method: "), method)))
    )
    return messages.withColumn("reply", reply)


def tool_result(text: Column, is_error: Column | None = None) -> Column:
    """A tool's text as the JSON of its result."""
    flag = F.lit("") if is_error is None else F.when(is_error, F.lit(',"isError":true')).otherwise(F.lit(""))
    return F.concat(F.lit('{"content":['), F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))), F.lit("]"), flag, F.lit("}"))
