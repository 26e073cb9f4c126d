"""Extension points: extractors, embedders, language models, model profiles and prompts."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import extract

MENTIONS = "type string, name string, alias string, start int, end int"


def noop_extractor(chunks: DataFrame, key: str) -> DataFrame:
    """No mentions; for tests of what comes after."""
    return chunks.select(key, *[F.lit(None).cast(t).alias(n) for n, t in (x.split(" ") for x in MENTIONS.split(", "))]).limit(0)


def dictionary_extractor(lexicon: DataFrame | list[tuple[str, str, str]]) -> Callable[[DataFrame, str], DataFrame]:
    """The offline extractor: the first occurrence of each name of a lexicon."""
    return lambda chunks, key: extract.dictionary_mentions(chunks, lexicon, key)


def batch_extractor(load: Callable[[], Callable[[list[str]], list[list[dict]]]]) -> Callable[[DataFrame, str], DataFrame]:
    """An extractor around a Python model: ``load`` runs once a worker, its result maps texts to lists of mentions."""

    def run(chunks: DataFrame, key: str) -> DataFrame:
        kind = chunks.schema[key].dataType.simpleString()

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for b in batches:
                found = model(b["text"].fillna("").tolist())
                yield pd.DataFrame([{key: k, **m} for k, ms in zip(b[key], found, strict=True) for m in ms], columns=[key, "type", "name", "alias", "start", "end"])

        return chunks.select(key, "text").mapInPandas(each, f"{key} {kind}, {MENTIONS}")

    return run


EXTRACTORS: dict[str, Callable] = {"noop": noop_extractor}


def register(registry: dict[str, Callable], name: str, what: Callable) -> None:
    """Adds a plug-in under a case-blind name."""
    registry[name.lower().strip()] = what


def get(registry: dict[str, Callable], name: str) -> Callable:
    key = name.lower().strip()
    if key not in registry:
        raise ValueError(f"unknown plug-in: {name}")
    return registry[key]


def hashing_embedder(size: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedder for offline use: words hashed into ``size`` places, scaled to unit length."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zlib

        for s in batches:
            out = np.zeros((len(s), size))
            for i, text in enumerate(s.fillna("")):
                for w in text.lower().split():
                    out[i, zlib.crc32(w.strip(".,;:!?()").encode()) % size] += 1
            n = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(out / np.where(n > 0, n, 1)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "array<double>")
    return lambda c: udf(c)


EMBEDDERS: dict[str, Callable] = {"hashing": hashing_embedder}


def window_semantics(windows: DataFrame, key: str, embed: Callable[[Column], Column], prototypes: dict[str, str] | None = None) -> DataFrame:
    """(key, w, type, semantic): cosine of each window with the prototype of each relationship type, 0 at least.

    Depends on the window and the type alone, so it is computed before any pair of mentions is made.
    """
    spark = windows.sparkSession
    rows = spark.createDataFrame(list((prototypes or dims.PROTOTYPES).items()), "type string, sentence string")
    vectors = [(r["type"], r["v"]) for r in rows.select("type", embed(F.col("sentence")).alias("v")).collect()]  # a row a type
    w = windows.select(key, "w", embed(F.col("window")).alias("v"))
    each = F.array(*[F.struct(F.lit(t).alias("type"), F.greatest(F.lit(0.0), extract.cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in v]))).alias("semantic")) for t, v in vectors])
    return w.select(key, "w", F.explode(each).alias("x")).select(key, "w", "x.type", F.round("x.semantic", 6).alias("semantic"))


def prompt(template: str, **values: Column) -> Column:
    """A prompt with its ``{placeholders}`` filled."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


CALLS = "q string, answer string, status string, error string, duration_ms long"


def model_calls(prompts: DataFrame, generate: Callable[[str], str], provider: str, model: str) -> DataFrame:
    """(q, answer, status, error, duration_ms, provider, model) for prompts (q, prompt): an audit row for every call."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for q, text in zip(b["q"], b["prompt"], strict=True):
                began = time.perf_counter()
                try:
                    answer, status, error = generate(text), "ok", ""
                except Exception as e:  # noqa: BLE001  the failure is the row's result
                    answer, status, error = None, "error", str(e)
                rows.append((str(q), answer, status, error, int(1000 * (time.perf_counter() - began))))
            yield pd.DataFrame(rows, columns=["q", "answer", "status", "error", "duration_ms"])

    return prompts.select(F.col("q").cast("string").alias("q"), "prompt").mapInPandas(each, CALLS).withColumns({"provider": F.lit(provider), "model": F.lit(model)})


MODELS: dict[str, Callable] = {"noop": lambda text: ""}
#: Profiles: settings by name; an alias names a profile.
PROFILES = {"noop": {"provider": "noop", "model": "noop", "retriever": "graph", "timeout": 90}, "local": {"provider": "local", "model": "local", "retriever": "graph", "timeout": 120}}
ALIASES = {"none": "noop", "default": "local"}


def profile(name: str | None = None, env: str = "MODEL", **explicit: object) -> dict:
    """A profile's settings; variables <env>_PROFILE, <env>_PROVIDER, ... override it, explicit values override both."""
    name = (name or os.environ.get(f"{env}_PROFILE") or "noop").lower().strip()
    name = ALIASES.get(name, name)
    if name not in PROFILES:
        raise ValueError(f"unknown profile: {name}")
    out = dict(PROFILES[name])
    out |= {k: type(v)(os.environ[f"{env}_{k.upper()}"]) for k, v in out.items() if f"{env}_{k.upper()}" in os.environ}
    return {**out, **{k: v for k, v in explicit.items() if v is not None}, "name": name}
