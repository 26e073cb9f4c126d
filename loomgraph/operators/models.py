"""Calls of language models over HTTP for a table of prompts: a bounded pool in every task, retries, a rate limit, a row for every call.

A task keeps at most ``workers`` calls under way and hands rows on as they are done, in the order of the prompts, so that it holds no
more than a pool's worth of answers.  With ``tasks`` the prompts are dealt to so many tasks, which bounds what a server sees: at most
tasks * workers calls at once, and tasks * per_second calls begun a second.

Defined cases: a call that fails is a row with status "error" and its reason, never a failed task; a server that is busy (429), out of
order (5xx) or silent is asked again, ``tries`` times in all, after ``pause`` seconds and twice as long each time, or as long as its
Retry-After says; other refusals are not repeated; a prompt that is null or blank is an error without a call; repeated prompts are
called each; with a schema an answer that is no JSON object is an error; an empty table gives an empty one.  A task that is repeated
after a lost executor calls again: write the result, then read that.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

RETRIED = {408, 425, 429, 500, 502, 503, 504}
CALLS = "answer string, status string, error string, tries int, duration_ms long"


class Refused(Exception):
    """An answer of no use; asking again would not help."""


def _text(result: dict) -> str:
    """The answer of a plain endpoint: an object under "json", or text under one of three names."""
    if isinstance(result.get("json"), dict):
        return json.dumps(result["json"])
    found = next((result[k] for k in ("text", "output", "answer") if result.get(k)), None)
    if not isinstance(found, str):
        raise Refused("the response has no text")
    return found


def _message(result: dict) -> str:
    """The answer of a chat endpoint."""
    found = (result.get("message") or {}).get("content")
    if not isinstance(found, str):
        raise Refused("the response has no message")
    return found


#: By provider: the body of a request (model, prompt, schema), and the text of its response.
PROVIDERS: dict[str, tuple[Callable, Callable]] = {
    "local": (lambda model, prompt, schema: {"model": model, "prompt": prompt} | ({"json_schema": schema} if schema else {}), _text),
    "chat": (lambda model, prompt, schema: {"model": model, "stream": False, "options": {"temperature": 0}, "messages": [{"role": "user", "content": prompt}]} | ({"format": schema} if schema else {}), _message),
}


def http(provider: str, model: str, url: str, schema: dict | None = None, timeout: float = 120) -> Callable[[str], str]:
    """One call: a prompt to its answer."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider}")

    def call(prompt: str) -> str:
        body, read = PROVIDERS[provider]
        request = urllib.request.Request(url, json.dumps(body(model, prompt, schema)).encode(), {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=timeout) as r:  # noqa: S310
            try:
                result = json.loads(r.read())
            except ValueError as e:
                raise Refused("the response is no JSON") from e
        if not isinstance(result, dict):
            raise Refused("the response is no object")
        return read(result)

    return call


def noop(prompt: str) -> str:
    """The offline model: an empty object."""
    return "{}"


class Pace:
    """Turns at most ``per_second`` times a second, for all threads of a task; the clock and sleep are given in tests."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next, self.lock = (1 / per_second if per_second else 0.0), clock, sleep, 0.0, threading.Lock()

    def turn(self) -> None:
        if not self.gap:
            return
        with self.lock:
            mine = max(self.next, self.clock())
            self.next = mine + self.gap
        if (wait := mine - self.clock()) > 0:
            self.sleep(wait)


def asked(prompt: str | None, call: Callable[[str], str], pace: Pace, tries: int, pause: float, as_object: bool, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str, str, int, int]:
    """(answer, status, error, tries, duration_ms) of one prompt."""
    if prompt is None or not prompt.strip():
        return None, "error", "no prompt", 0, 0
    began, error = time.perf_counter(), ""
    for n in range(1, tries + 1):
        pace.turn()
        wait = pause * 2 ** (n - 1)
        again = False
        try:
            answer = call(prompt)
            if as_object and not isinstance(json.loads(answer), dict):
                raise Refused("the answer is no JSON object")
        except urllib.error.HTTPError as e:
            error, again = f"HTTP {e.code}", e.code in RETRIED
            said = e.headers.get("Retry-After", "") if e.headers else ""
            wait = float(said) if said.isdigit() else wait
        except ValueError:
            error = "the answer is no JSON object"
        except OSError as e:  # refused connections and time-outs
            error, again = str(e) or type(e).__name__, True
        except Exception as e:  # noqa: BLE001  the failure is the row's result
            error = str(e) or type(e).__name__
        else:
            return answer, "ok", "", n, int(1000 * (time.perf_counter() - began))
        if not again or n == tries:
            return None, "error", error, n, int(1000 * (time.perf_counter() - began))
        sleep(wait)
    raise ValueError("tries must be 1 at least")


def calls(prompts: DataFrame, call: Callable[[str], str], key: list[str], prompt: str = "prompt", workers: int = 4, tasks: int | None = None, tries: int = 3, pause: float = 1.0, per_second: float | None = None, as_object: bool = False, rows: int = 64) -> DataFrame:
    """(key columns, CALLS): an audit row for each prompt; ``call`` is ``http(...)``, ``noop`` or any function of a prompt."""
    if workers < 1 or tries < 1:
        raise ValueError("workers and tries must be 1 at least")
    ship(prompts.sparkSession)
    named = [f"_k{n}" for n in range(len(key))]
    own = prompts.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, named, strict=True)], F.col(f"`{prompt}`").alias("_prompt"))
    fields = [c.split()[0] for c in CALLS.split(", ")]
    schema = ", ".join([*(f"{n} {prompts.schema[k].dataType.simpleString()}" for k, n in zip(key, named, strict=True)), CALLS])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace, under_way = Pace(per_second), deque()
        kept, done = [], []

        def made() -> pa.RecordBatch:
            keys = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            out = [pa.array([x[n] for x in done], pa.from_numpy_dtype(kind) if kind else pa.string()) for n, kind in enumerate((None, None, None, "int32", "int64"))]
            return pa.RecordBatch.from_arrays([*keys.columns, *out], [*named, *fields])

        def taken() -> None:
            row, call_ = under_way.popleft()
            kept.append(row)
            done.append(call_.result())

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                keys, texts = b.select(named), b.column("_prompt").to_pylist()
                for k, text in enumerate(texts):
                    under_way.append((keys.slice(k, 1), pool.submit(asked, text, call, pace, tries, pause, as_object)))
                    if len(under_way) >= 2 * workers:
                        taken()
                    if len(done) >= rows:
                        yield made()
                        kept.clear()
                        done.clear()
            while under_way:
                taken()
        if done:
            yield made()

    dealt = own.repartition(tasks) if tasks else own
    return dealt.mapInArrow(each, schema).withColumnsRenamed(dict(zip(named, key, strict=True)))
