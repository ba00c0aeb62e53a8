"""Batch model calls: a function the caller supplies, run over the partitions of a table.

`make_model` builds that function once per partition on the executor, so clients and keys never travel with the plan.
Calls keep the input columns and append their outcome; a call that raises marks its own row and no other.
"""

from __future__ import annotations

import ast
import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.IGNORECASE)


def _with_columns(df: DataFrame, added: str) -> T.StructType:
    return T.StructType(df.schema.fields + T._parse_datatype_string(added).fields)


def _run(df: DataFrame, make_model: Callable, args: list[str]) -> DataFrame:
    schema = _with_columns(df, "reply string, error string, attempts int, latency_ms double")

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            rows = []
            for values in zip(*[pdf[a] for a in args], strict=True):
                begun = time.monotonic()
                try:
                    reply, error = model(*values), None
                except Exception as exc:  # one bad call must not fail its neighbours
                    reply, error = None, str(exc)
                rows.append((reply, error, 1, (time.monotonic() - begun) * 1000))
            yield pdf.assign(**dict(zip(("reply", "error", "attempts", "latency_ms"), zip(*rows, strict=True), strict=True))) if rows else pdf.assign(
                reply=None, error=None, attempts=0, latency_ms=0.0
            )

    return df.mapInPandas(calls, schema)


def call_text(df: DataFrame, prompt_col: str, make_model: Callable[[], Callable[[str], str]]) -> DataFrame:
    """Reply to each prompt: appends reply, error, attempts, latency_ms."""
    return _run(df, make_model, [prompt_col])


def call_image(df: DataFrame, bytes_col: str, prompt_col: str, make_model: Callable[[], Callable[[bytes, str], str]]):
    """Reply to each image and prompt: appends reply, error, attempts, latency_ms."""
    return _run(df, make_model, [bytes_col, prompt_col])


def read_json(reply: str) -> dict:
    """Object in a model reply; raises ValueError when there is none."""
    text = _FENCE.sub("", reply.strip())
    inner = text[text.find("{") : text.rfind("}") + 1]
    for candidate, read in ((text, json.loads), (text, ast.literal_eval), (inner, json.loads)):
        try:
            value = read(candidate)
        except (ValueError, SyntaxError):
            continue
        if isinstance(value, dict):
            return value
    raise ValueError("reply is not valid JSON")


def call_with_repair(
    df: DataFrame, prompt_col: str, make_model: Callable, check: Callable[[dict], None] | None = None, max_attempts: int = 3
) -> DataFrame:
    """Call until the reply parses, and passes `check`, at most `max_attempts` times.

    Each further prompt carries the bad reply and what was wrong with it. Appends reply (the last one), error (null on
    success), attempts and latency_ms; failed rows are the caller's to reject or to read leniently.
    """
    schema = _with_columns(df, "reply string, error string, attempts int, latency_ms double")

    def one(model: Callable[[str], str], prompt: str) -> tuple:
        begun, ask, reply, error = time.monotonic(), prompt, None, None
        for attempt in range(1, max_attempts + 1):
            try:
                reply = model(ask)
            except Exception as exc:  # a call that raises is not a bad reply: it fails the row at once
                return reply, str(exc), attempt, (time.monotonic() - begun) * 1000
            try:
                value = read_json(reply)
                if check:
                    check(value)
                return reply, None, attempt, (time.monotonic() - begun) * 1000
            except ValueError as exc:
                error = str(exc)
                ask = f"{prompt}\n\nThe reply was:\n{reply}\n\nIt cannot be used ({error}). Reply with the JSON object alone."
        return reply, error, max_attempts, (time.monotonic() - begun) * 1000

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            out = pd.DataFrame(
                [one(model, p) for p in pdf[prompt_col]], columns=["reply", "error", "attempts", "latency_ms"], index=pdf.index
            )
            yield pd.concat([pdf, out], axis=1)

    return df.mapInPandas(calls, schema)


def split_rejects(called: DataFrame) -> tuple[DataFrame, DataFrame]:
    return called.where("error IS NULL"), called.where("error IS NOT NULL")


def call_embed(df: DataFrame, text_col: str, make_model: Callable[[], Callable[[list], list]], size: int = 100):
    """Vector of each row's text; equal texts are embedded once, in batches of `size`.

    Distinct texts are found by their hash, so the shuffle carries a text once per task at most; vectors come back by
    the same hash, and a text repeated across much of the table leaves its rows spread out by AQE's skew splitting.
    """
    keyed = df.withColumn("_h", F.sha2(text_col, 256))
    texts = keyed.groupBy("_h").agg(F.any_value(text_col).alias("_text"))

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            for at in range(0, len(pdf), size):
                part = pdf.iloc[at : at + size]
                vectors = model(list(part["_text"]))
                if len(vectors) != len(part):
                    raise ValueError(f"model returned {len(vectors)} vectors for {len(part)} texts")
                yield pd.DataFrame({"_h": part["_h"].to_numpy(), "embedding": list(vectors)})

    vectors = texts.mapInPandas(embed, "_h string, embedding array<double>")
    return keyed.join(vectors, "_h", "left").drop("_h")


def call_stats(calls: DataFrame, by: str) -> DataFrame:
    """Calls, repeats, failures and latency per provider."""
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.col("attempts") - 1).alias("retries"),
        F.count("error").alias("failures"),
        F.round(F.sum(F.col("latency_ms").cast("decimal(24,4)")).cast("double") / F.count("latency_ms"), 4).alias("mean_latency_ms"),
        F.round(F.max("latency_ms"), 4).alias("max_latency_ms"),
    )
