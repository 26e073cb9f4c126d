"""Model calls against a server of the test's own: retries, refusals, bounded concurrency, pace."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loomgraph.operators import models


class Server(BaseHTTPRequestHandler):
    asked, now, most, lock = Counter(), 0, 0, threading.Lock()

    def do_POST(self):  # noqa: N802
        cls = Server
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        prompt = body["prompt"] if "prompt" in body else body["messages"][0]["content"]
        with cls.lock:
            cls.asked[prompt] += 1
            n = cls.asked[prompt]
            cls.now += 1
            cls.most = max(cls.most, cls.now)
        time.sleep(0.02)
        with cls.lock:
            cls.now -= 1
        word = prompt.split()[0]
        code, out = 200, {"text": f"said {prompt}"}
        if word == "flaky" and n < 3:
            code = 503
        elif word == "busy" and n < 2:
            code = 429
        elif word == "down":
            code = 500
        elif word == "bad":
            code = 400
        elif word == "list":
            out = {"text": "[1]"}
        elif word == "object":
            out = {"json": {"a": 1}}
        elif word == "mute":
            out = {}
        if "messages" in body:
            out = {"message": {"content": f"chat {prompt}"}}
        raw = json.dumps(out).encode()
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0")
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    Server.asked, Server.now, Server.most = Counter(), 0, 0
    s = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/generate"
    s.shutdown()
    s.server_close()


def test_rows_for_every_outcome(spark, url):
    texts = ["fine", "flaky one", "busy one", "down", "bad", "mute", None, "  "]
    prompts = spark.createDataFrame([(k, "x" if k else None, t) for k, t in enumerate(texts)], "q long, tag string, prompt string")
    out = models.calls(prompts, models.http("local", "m", url, timeout=10), ["q", "tag"], tasks=1, pause=0.01).collect()
    assert [(r["q"], r["tag"], r["answer"], r["status"], r["error"], r["tries"]) for r in sorted(out)] == [
        (0, None, "said fine", "ok", "", 1), (1, "x", "said flaky one", "ok", "", 3), (2, "x", "said busy one", "ok", "", 2), (3, "x", None, "error", "HTTP 500", 3), (4, "x", None, "error", "HTTP 400", 1),
        (5, "x", None, "error", "the response has no text", 1), (6, "x", None, "error", "no prompt", 0), (7, "x", None, "error", "no prompt", 0)]
    assert Server.asked["bad"] == 1 and Server.asked["down"] == 3


def test_objects_and_chat(spark, url):
    prompts = spark.createDataFrame([(0, "object"), (1, "list"), (2, "plain words")], "q int, prompt string")
    out = sorted(models.calls(prompts, models.http("local", "m", url, schema={"type": "object"}), ["q"], as_object=True).select("q", "answer", "error").collect())
    assert [tuple(r) for r in out] == [(0, '{"a": 1}', ""), (1, None, "the answer is no JSON object"), (2, None, "the answer is no JSON object")]
    chat = models.calls(prompts.limit(1), models.http("chat", "m", url), ["q"]).first()
    assert (chat["answer"], chat["status"]) == ("chat object", "ok")
    with pytest.raises(ValueError, match="unknown provider"):
        models.http("other", "m", url)


def test_calls_at_once_are_bounded_and_no_prompt_is_lost(spark, url):
    prompts = spark.range(300).selectExpr("id as q", "concat('p ', id % 150) as prompt")
    out = models.calls(prompts, models.http("local", "m", url), ["q"], workers=3, tasks=2).collect()
    assert sorted(r["q"] for r in out) == list(range(300)) and all(r["answer"] == f"said p {r['q'] % 150}" for r in out)
    assert sum(Server.asked.values()) == 300 and 1 < Server.most <= 6


def test_a_server_that_is_not_there(spark):
    prompts = spark.createDataFrame([(0, "a")], "q int, prompt string")
    r = models.calls(prompts, models.http("local", "m", "http://127.0.0.1:9/x", timeout=2), ["q"], tries=2, pause=0.01).first()
    assert (r["status"], r["tries"], r["answer"]) == ("error", 2, None) and "refused" in r["error"]
    assert models.calls(prompts.limit(0), models.noop, ["q"]).count() == 0


def test_waits_double_and_turns_are_paced():
    waits, now = [], [0.0]

    def down(_):
        raise TimeoutError("silent")

    assert models.asked("p", down, models.Pace(None), 4, 1.0, False, waits.append)[:4] == (None, "error", "silent", 4)
    assert waits == [1.0, 2.0, 4.0]
    slept = []
    pace = models.Pace(4, lambda: now[0], slept.append)
    for _ in range(3):
        pace.turn()
    assert slept == [0.25, 0.5]
