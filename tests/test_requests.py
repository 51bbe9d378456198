"""Requests: bounds, messages, and the stream."""

import json

from pyspark.sql import functions as F

from tessel.sources.requests import parse_messages, report_outcome, validate_files, validate_reports
from tessel.streaming.protocol import replies
from tessel.streaming.service import append_reports, read_requests, respond, serve

AS_OF = "2026-08-07 00:00:00"


def test_bounds_of_files(spark):
    rows = [("many", k, "p", "c") for k in range(51)] + [("ok", 0, "p", ""), ("path", 0, "", "c"), ("path", 1, None, "c"), ("content", 0, "p", None), ("long", 0, "x" * 1025, "c"), ("large", 0, "p", "c" * 200_001)]
    good, errors = validate_files(spark.createDataFrame(rows, "scan_id string, file_ord int, path string, content string"))
    assert [r.scan_id for r in good.collect()] == ["ok"]
    got = {r.scan_id: r.error for r in errors.collect()}
    assert set(got) == {"many", "path", "content", "long", "large"} and got["path"] == "files[0].path must have at least 1 characters" and got["content"] == "files[0].content must be a string"


def test_reports(spark):
    rows = [("a", "npm", None), ("a", "go", None), (None, "npm", None), ("x" * 215, "npm", None), ("a", None, None), ("a", "gems", "x"), ("a", "gems", "me")]
    got = validate_reports(spark.createDataFrame(rows, "package string, ecosystem string, reporter string")).collect()
    assert [r.error is None for r in got] == [True, False, False, False, False, False, True]
    kinds = spark.createDataFrame([("accepted",), ("duplicate",), ("rejected",), ("unverifiable",), ("else",)], "s string")
    assert [r[0] for r in kinds.select(report_outcome(F.col("s"), F.lit("n"), F.lit(None).cast("string"), F.lit(500))).collect()] == [
        "Reported: n is on the list now.", "The name is on the list already.", "Not accepted: the report was rejected.", "Could not verify: the registry was not reached; nothing was stored.", "Unexpected answer (HTTP 500); nothing was stored.",
    ]


def call(number, *pairs, **extra):
    return json.dumps({"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": "pre_flight_check", "arguments": {"files": [{"path": p, "content": c} for p, c in pairs]} | extra}})


def test_messages(spark):
    lines = [call(1, ("a.py", "import x")), "  ", "{broken", "[" + call(2, ("b.py", "y")) + ', {"id": null, "method": "ping"}]', '{"id": "s", "method": "initialize"}']
    good, bad = parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((str(r.id), r.method) for r in good.collect()) == [('"s"', "initialize"), ("1", "tools/call"), ("2", "tools/call"), ("null", "ping")]
    assert [(r.value, r.code) for r in bad.collect()] == [("{broken", -32700)]


def known_answers(spark):
    return spark.createDataFrame([("pypi", "ghost", 404, "")], "ecosystem string, name string, status int, body string")


def asked(spark, lines, feed=None):
    """The replies by the number of the line."""
    df = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    rows = respond(df, known_answers(spark), AS_OF, feed).collect()
    assert len({r.line for r in rows}) == len(rows)
    return {r.line: json.loads(r.reply) for r in rows}


def report(number, **args):
    return json.dumps({"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": "report_hallucination", "arguments": args}})


def test_respond(spark):
    raw = lambda n, args: json.dumps({"id": n, "method": "tools/call", "params": {"name": "pre_flight_check", "arguments": args}})
    lines = [
        call(1, ("requirements.txt", "ghost"), context="why"), call("two", ("a.txt", "")), call(3, ("", "x")), "nonsense", call(4, ("a.txt", ""), context="x" * 501), call(5), call(6, ("a.txt", "")).replace("pre_flight_check", "other"),
        '{"method": "notifications/initialized"}', "  ", "[]", "5", "[" + call(10, ("a.txt", "")) + ', {"id": 11, "method": "ping"}, {"method": "notifications/x"}, 7]', '[{"method": "notifications/x"}]', '{"id": 12, "method": 5}',
        '{"id": 13, "method": "nope"}', raw(14, []), raw(15, {"files": "x"}), raw(16, {"files": [5]}), raw(17, {"files": [{"path": 5, "content": ""}]}), raw(18, {"files": [{"path": "a", "content": ""}], "context": 5}),
        raw(19, {"files": [{"path": "a", "content": ""}] * 51}), call(20, ("a.txt", "")).replace('"id": 20, ', ""), '{"id": 21, "method": "ping"} x', raw(22, {"files": [{"path": "a", "content": None}]}),
    ]
    got = asked(spark, lines)
    text = lambda r: json.loads(r["result"]["content"][0]["text"])
    assert set(got) == set(range(24)).difference([7, 8, 12])
    assert got[0]["id"] == 1 and text(got[0])["verdict"] == "BLOCKED" and text(got[0])["summary"] == {"filesChecked": 1, "critical": 1, "warnings": 0, "context": "why"}
    assert got[1]["id"] == "two" and text(got[1])["verdict"] == "CLEAR" and text(got[1])["summary"]["context"] is None
    codes = {k: (r["id"], r["error"]["code"]) for k, r in got.items() if isinstance(r, dict) and "error" in r}
    assert codes == {
        2: (3, -32602), 3: (None, -32700), 4: (4, -32602), 5: (5, -32602), 6: (6, -32602), 9: (None, -32600), 10: (None, -32600), 13: (12, -32600), 14: (13, -32601), 15: (14, -32602), 16: (15, -32602), 17: (16, -32602), 18: (17, -32602), 19: (18, -32602), 20: (19, -32602),
        22: (None, -32700), 23: (22, -32602),
    }
    assert [x.get("id") for x in got[11]] == [10, 11, None] and text(got[11][0])["verdict"] == "CLEAR" and got[11][1]["result"] == {} and got[11][2]["error"]["code"] == -32600
    assert got[21]["id"] is None and text(got[21])["verdict"] == "CLEAR"
    assert got[15]["error"]["message"] == "arguments must be an object" and got[17]["error"]["message"] == "files[0] must be an object" and got[18]["error"]["message"] == "files[0].path must be a string" and got[20]["error"]["message"] == "files must have at most 50 entries"


def test_report_calls(spark):
    feed = spark.createDataFrame([("a", "npm", "accepted", "a", None, 200), ("b", "pypi", "rejected", None, "it exists", 200), ("c", "gems", "odd", None, None, 500), ("d", "npm", "duplicate", None, None, 200), ("u", "npm", "unverifiable", None, None, 200)], "package string, ecosystem string, status string, name string, reason string, http int")
    lines = [report(0, package="a", ecosystem="npm"), report(1, package="b", ecosystem="pypi", reporter="me"), report(2, package="c", ecosystem="gems"), report(3, package="d", ecosystem="npm"), report(4, package="x", ecosystem="npm"), report(5, package="x", ecosystem="go"), report(6, package=5, ecosystem="npm"), report(7, package="a", ecosystem="npm", reporter="x"), report(8, package="u", ecosystem="npm")]
    got = asked(spark, lines, feed)
    words = {k: r["result"]["content"][0]["text"] for k, r in got.items() if "result" in r}
    assert words == {
        0: "Reported: a is on the list now.", 1: "Not accepted: it exists.", 2: "Unexpected answer (HTTP 500); nothing was stored.", 3: "The name is on the list already.", 4: "The report did not reach the list; nothing was stored.",
        8: "Could not verify: the registry was not reached; nothing was stored.",
    }
    assert [k for k, r in got.items() if r.get("result", {}).get("isError")] == [4] and {k: got[k]["error"]["code"] for k in (5, 6, 7)} == {5: -32602, 6: -32602, 7: -32602}


def test_replies(spark):
    lines = ['{"id": 1, "method": "ping"}', '{"id": "a", "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}', '{"id": 3, "method": "initialize", "params": {"protocolVersion": "1"}}', '{"id": 4, "method": "tools/list"}', '{"id": 5, "method": "no\\"pe"}', '{"id": 6}', '{"method": "notifications/initialized"}', '{"id": 7, "method": "tools/call", "params": {"name": "x"}}', call(8)]
    got = [json.loads(r.reply) if r.reply else None for r in replies(parse_messages(spark.createDataFrame([(x,) for x in lines], "value string"))[0]).collect()]
    by = {r["id"]: r for r in got if r}
    assert got.count(None) == 2 and by[1]["result"] == {} and by["a"]["result"]["protocolVersion"] == "2024-11-05" and by[3]["result"]["protocolVersion"] == "2025-11-25"
    assert [t["name"] for t in by[4]["result"]["tools"]] == ["pre_flight_check", "report_hallucination"] and {k: by[k]["error"]["code"] for k in (5, 6, 7)} == {5: -32601, 6: -32600, 7: -32602}


def test_stream(spark, tmp_path):
    requests = tmp_path / "in"
    requests.mkdir()
    for k in range(6):
        (requests / f"{k}.txt").write_text(call(k, ("requirements.txt", "ghost" if k % 2 else "# none")) + "\n\nbroken\n" + json.dumps({"id": f"p{k}", "method": "ping"}) + "\n" + report(f"r{k}", package=f"n{k}", ecosystem="npm") + "\n")
    paths = [str(tmp_path / x) for x in ("out", "checkpoint")]
    for _ in range(2):  # the second start finds nothing new
        serve(read_requests(spark, str(requests), 2), known_answers(spark), AS_OF, *paths, reports_path=str(tmp_path / "reports")).awaitTermination(300)
    rows = spark.read.parquet(paths[0])
    got = [json.loads(r.reply) for r in rows.collect()]
    text = lambda r: json.loads(r["result"]["content"][0]["text"])
    assert {r["id"]: text(r)["verdict"] for r in got if isinstance(r["id"], int)} == {k: "BLOCKED" if k % 2 else "CLEAR" for k in range(6)} and len(got) == 24
    assert sum(r["id"] is None for r in got) == 6 and {r["id"] for r in got if isinstance(r["id"], str)} == {f"{x}{k}" for x in "pr" for k in range(6)}
    assert rows.select("batch").distinct().count() == 3 and sorted(r.package for r in spark.read.parquet(str(tmp_path / "reports")).collect()) == [f"n{k}" for k in range(6)]


def test_reports_sink(spark, tmp_path):
    folder = tmp_path / "reports"
    folder.mkdir()
    (folder / "a.json").write_text('{"package": "x", "ecosystem": "npm"}\n{"package": "y", "ecosystem": "go"}\n')
    stream = validate_reports(spark.readStream.schema("package string, ecosystem string, reporter string").json(str(folder)))
    append_reports(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [r.package for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["x"]
