"""Console queries, sinks, settings and the remote inspector."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidegate.config import Config
from tidegate.plans import api
from tidegate.sources import ingest, remote, sinks

TEXT = "DB host config: password=Sup3rSecret! for the migration. Candidate NRIC S7712345A is on file."


@pytest.fixture(scope="module")
def items(spark):
    texts = spark.createDataFrame([("j", 0, TEXT), ("j", 1, "all fine"), ("k", 0, "other job")], "job_id string, ord int, text string")
    return ingest.stage_batch(None, texts).cache()


def test_drill_down_and_reveal(items):
    verdicts, found = api.run_inspection(items, Config({}))
    assert {r["item_id"]: r["decision"] for r in verdicts.collect()} == {"j-0": "BLOCK", "j-1": "PASS", "k-0": "PASS"}
    listed, shown = api.item_detail(items, found, "j", "j-0")
    assert [r["code"] for r in listed.collect()] == ["SECRET_CREDENTIAL", "PII"]
    assert [p["kind"] for p in shown.first()["parts"]] == ["plain", "mask", "plain", "mask", "plain"]
    assert api.reveal(items, found, "j", "j-0", "Text", 1).first()["value"] == "S7712345A"
    assert api.reveal(items, found, "j", "j-0", "Text", 9).count() == api.reveal(items, found, "k", "j-0", "Text", 0).count() == 0
    assert api.item_detail(items, found, "k", "j-0")[0].count() == 0


def test_confirmation(spark):
    jobs = spark.createDataFrame([("a", "DRAFT", None), ("b", "DONE", 1.0), ("c", "DRAFT", None)], "job_id string, status string, confirmed_at double")
    rows = {r["job_id"]: (r["status"], r["confirmed_at"], r["conflict"]) for r in api.confirmed(jobs, ["a", "b"], 5.0).collect()}
    assert rows == {"a": ("QUEUED", 5.0, False), "b": ("DONE", 1.0, True), "c": ("DRAFT", None, False)}


def test_settings():
    config = Config({"SHORT_CIRCUIT": "Yes", "MAX_FILE_BYTES": "12", "MAX_FILES_PER_JOB": "many"})
    assert config.short_circuit and config.max_file_bytes == 12 and config.max_files == 50
    assert api.health(Config({"GUARD_BACKEND": " Lexical "}))["guard_backend"] == "lexical"
    with pytest.raises(KeyError):
        api.gate(api.GUARDS, "none")


def test_sinks_replace_what_a_second_run_writes(spark, items, tmp_path):
    for _ in range(2):
        sinks.write_segments(items, str(tmp_path / "s"))
        sinks.append(items.select("job_id", "item_id"), str(tmp_path / "t"))
    assert sinks.read_segments(spark, str(tmp_path / "s")).count() == 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_reports(spark):
    files = spark.createDataFrame([("a", b"\xef\xbb\xbfhello"), ("b", b"bad \xff"), ("c", "x​y é".encode())], "source_name string, content binary")
    rows = {r["source_name"]: r for r in sinks.reports(files).collect()}
    assert [rows[k]["exit_code"] for k in "abc"] == [0, 3, 0] and rows["b"]["sanitized"] is None
    assert rows["a"]["sanitized"] == "hello" and rows["c"]["sanitized"] == "xy é"
    assert json.loads(rows["b"]["report"])["findings"][0]["code"] == "INVALID_UTF8" and json.loads(rows["a"]["report"])["risk_tier"] == "LOW"


class Server(BaseHTTPRequestHandler):
    tokens = 0
    seen: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        auth = self.headers.get("Authorization", self.headers.get("X-API-Key", ""))
        if self.path == "/token":
            if b"client_secret" in body:
                return self.answer(401, {})
            Server.tokens += 1
            return self.answer(200, {"access_token": f"t{Server.tokens}", "expires_in": 3600})
        Server.seen.append(auth)
        if auth == "Bearer t1":
            return self.answer(401, {})
        asked = json.loads(body)["messages"][1]["content"]
        return self.answer(500 if "boom" in asked else 200, {"choices": [{"message": {"content": 'sure {"decision":"PASS"} ok'}}]})

    def answer(self, code, found):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(found).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_remote_modes(address):
    for mode, want in (("none", ""), ("bearer", "Bearer k"), ("basic", "Basic dTpz"), ("header", "k")):
        client = remote.Client(f"{address}/chat", "m", "p", auth=mode, key="k", user="u", secret="s")
        assert "PASS" in client.ask("text") and Server.seen[-1] == want
    client = remote.Client(f"{address}/chat", "m", "p", auth="oauth2", user="u", secret="s", token_url=f"{address}/token")
    assert "PASS" in client.ask("text") and Server.seen[-2:] == ["Bearer t1", "Bearer t2"]
    assert "PASS" in client.ask("text") and Server.tokens == 2


def test_remote_inspector_blocks_what_fails(spark, address):
    inspector = remote.remote_inspector(url=f"{address}/chat", model="m", prompt="p", timeout=10.0)
    df = spark.createDataFrame([(0, "fine"), (1, "boom"), (2, None)], "i int, text string")
    rows = df.select("i", inspector(F.col("text")).alias("v")).orderBy("i").collect()
    assert [r["v"]["decision"] for r in rows] == ["PASS", "BLOCK", "BLOCK"]
